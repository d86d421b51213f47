"""Streams give what batch queries give."""

from corpusmill.operators.ordered import latest
from corpusmill.streaming import buckets, journal

SCHEMA = "user_id long, ts timestamp, event_type string, event_id long"


def test_journal_state_over_batches(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("in", "state", "log"))
    rows = spark.sql("SELECT id % 7 AS user_id, timestamp_seconds(id * 1000 % 9973) AS ts, concat('e', id % 3) AS event_type, id AS event_id FROM range(300)")
    for part in (0, 1):
        rows.filter(f"event_id % 2 = {part}").write.mode("append").parquet(src)
        journal.latest_state(journal.read_events(spark, src, SCHEMA), ["user_id"], ["ts", "event_id"], out, log).awaitTermination()
    got = {r.user_id: (r.ts, r.event_id) for r in journal.read_state(spark, out).collect()}
    assert got == {r.user_id: (r.ts, r.event_id) for r in latest(rows, ["user_id"], "ts", "event_id").collect()}
    assert journal.read_state(spark, str(tmp_path / "none")) is None


def test_daily_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT id % 7 AS user_id, timestamp_seconds(id * 3600) AS ts, 'e' AS event_type, id AS event_id FROM range(72)").coalesce(1).write.parquet(src)
    q = journal.daily_counts(journal.read_events(spark, src, SCHEMA)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("daily").collect()) == [24, 24, 24]


def test_state_in_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.sql("SELECT IF(id % 41 = 0, NULL, id % 41) AS user_id, id * 7919 % 9973 AS ts, id AS event_id FROM range(2000)")
    keys, order = ["user_id"], ["ts", "event_id"]
    whole = lambda df: sorted(map(repr, df.collect()))
    assert buckets.read_buckets(spark, path) is None
    buckets.merge_batch(rows.filter("event_id < 1000"), 0, keys, order, path, buckets=8)
    buckets.merge_batch(rows.filter("event_id >= 1000"), 1, keys, order, path)
    assert whole(buckets.read_buckets(spark, path)) == whole(latest(rows, keys, *order))
    one = spark.sql("SELECT 5L AS user_id, 10000L AS ts, 1L AS event_id")
    buckets.merge_batch(one, 2, keys, order, path)
    assert [p.name[:3] for p in (tmp_path / "state/data/v=2").iterdir() if p.is_dir()] == ["_b="]
    after = whole(latest(rows.union(one), keys, *order))
    assert whole(buckets.read_buckets(spark, path)) == after
    assert whole(buckets.read_buckets(spark, path, 1)) == whole(latest(rows, keys, *order))
    # a batch done again changes nothing; a late row loses; an empty batch leaves all as it is
    buckets.merge_batch(one, 2, keys, order, path)
    buckets.merge_batch(spark.sql("SELECT 5L AS user_id, 3L AS ts, 9L AS event_id"), 3, keys, order, path)
    buckets.merge_batch(one.limit(0), 4, keys, order, path)
    assert whole(buckets.read_buckets(spark, path)) == after
    assert buckets.manifests(spark, path) == [3, 4]
    # of version 0 and 1 only what still counts is there
    left = [(p.parent.name, p.name) for p in (tmp_path / "state/data").glob("v=*/_b=*")]
    assert len({b for _, b in left}) == len(left) == 8
    # a run that broke off before its manifest is written over
    (tmp_path / "state/data/v=5/_b=0").mkdir(parents=True)
    (tmp_path / "state/data/v=5/_b=0/part-0.parquet").write_bytes(b"broken")
    late = spark.sql("SELECT id AS user_id, 20000L AS ts, id AS event_id FROM range(60)")
    buckets.merge_batch(late, 5, keys, order, path)
    assert whole(buckets.read_buckets(spark, path)) == whole(latest(rows.union(one).union(late), keys, *order))
