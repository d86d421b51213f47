"""Streams: a journal folded to the latest state of each key, and daily counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest, upsert


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def latest_state(events: DataFrame, keys: list[str], order: list[str], state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep `state_path` at the latest row of each key.

    Each batch is folded to one row per key, merged with the state before it and written as a new
    version `v=<batch>`; a batch that runs again after a failure reads the version before it and
    writes the same rows, so the result is exactly once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, keys, *order)
        before = read_state(spark, state_path, number - 1)
        new = fresh if before is None else upsert(before, fresh.select(before.columns), keys, *order)
        new.write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str, number: int | None = None) -> DataFrame | None:
    """State after batch `number`, or the last one; None where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(state_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("v=")]
    found = [n for n in found if number is None or n <= number]
    return spark.read.parquet(f"{state_path}/v={max(found)}") if found else None


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts by day and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: a cache that forgets."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
