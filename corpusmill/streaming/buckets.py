"""The latest row of each key in buckets of keys: a batch rewrites the buckets that it touches and no others.

`path/data/v=<batch>/_b=<bucket>` holds rows, `path/manifest-<batch>.json` says which version of each
bucket counts after a batch, along with the number of buckets and the schema.  A manifest is written
beside and renamed, so a reader sees the state after one batch whole.  A batch that failed before its
manifest is written again over what it left; one that is complete is not done twice.  The last two
manifests and what they name stay, so a reader that began before a batch can end; older ones go.

Null keys are keys like others; ties in the order columns are settled by all columns of the order
given, so name enough of them; an empty batch writes a manifest only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as DT
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest, upsert

#: Buckets of a new state; choose them so that one bucket is about one task's worth of rows.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose state can be read, in order."""
    hadoop, fs = _files(spark, path)
    if not fs.exists(hadoop.Path(path)):
        return []
    names = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(hadoop.Path(path)))
    return sorted(int(m[1]) for m in names if m)


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest-{number}.json", wholetext=True).first()[0])


def _folder(path: str, bucket: str, version: int) -> str:
    return f"{path}/data/v={version}/_b={bucket}"


def _rows(spark: SparkSession, path: str, m: dict, buckets: list[str]) -> DataFrame:
    schema = DT.StructType.fromJson(m["schema"])
    own = [_folder(path, b, m["versions"][b]) for b in buckets if b in m["versions"]]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """State after batch `number`, or after the last one; None where there is none."""
    known = [n for n in manifests(spark, path) if number is None or n <= number]
    if not known:
        return None
    m = _manifest(spark, path, known[-1])
    return _rows(spark, path, m, sorted(m["versions"]))


def merge_batch(batch: DataFrame, number: int, keys: list[str], order: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Bring the state at `path` to the latest row of each key after this batch; the number of buckets is that of the first batch."""
    spark = batch.sparkSession
    known = manifests(spark, path)
    if number in known:
        return
    before = [n for n in known if n < number]
    m = _manifest(spark, path, before[-1]) if before else {"buckets": buckets, "schema": latest(batch, keys, *order).schema.jsonValue(), "versions": {}}
    schema = DT.StructType.fromJson(m["schema"])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(m["buckets"])).cast("int")
    fresh = latest(batch, keys, *order).select(schema.fieldNames())
    # one row for each bucket at most
    touched = sorted(str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect())
    if touched:
        rows = upsert(_rows(spark, path, m, touched), fresh, keys, *order).withColumn("_b", bucket)
        rows.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/data/v={number}")
    _publish(spark, path, number, m | {"versions": m["versions"] | dict.fromkeys(touched, number)})
    _forget(spark, path)


def _publish(spark: SparkSession, path: str, number: int, m: dict) -> None:
    hadoop, fs = _files(spark, path)
    beside, name = hadoop.Path(f"{path}/_manifest-{number}.tmp"), hadoop.Path(f"{path}/manifest-{number}.json")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(m).encode()))
    out.close()
    if not fs.rename(beside, name):
        raise RuntimeError(f"could not publish {name}")


def _forget(spark: SparkSession, path: str) -> None:
    """What only manifests before the last two name goes, data first, so that a broken run is taken up by the next."""
    hadoop, fs = _files(spark, path)
    known = manifests(spark, path)
    kept = {x for n in known[-2:] for x in _manifest(spark, path, n)["versions"].items()}
    for n in known[:-2]:
        for b, v in set(_manifest(spark, path, n)["versions"].items()) - kept:
            fs.delete(hadoop.Path(_folder(path, b, v)), True)
        fs.delete(hadoop.Path(f"{path}/manifest-{n}.json"), False)


def latest_in_buckets(events: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A stream folded into the state at `path`, batch by batch."""
    return events.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, keys, order, path, buckets)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
