"""Ordered operators: context windows, packing with a reset, first-wins, state folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key, order) -> DataFrame:
    """One row for each key, the first by `order`; an aggregate, so a hot key is folded before the shuffle."""
    names = df.columns
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*names), order).alias("r")).select("r.*")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order)).alias("r")).select(*keys, "r.*")


def context(df: DataFrame, group: str, order: str, value: str, before: int = 2) -> DataFrame:
    """`df` with the `before` values that come before each row, joined by line ends."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-before, -1)
    return df.withColumn("context", F.array_join(F.collect_list(value).over(w), "\n"))


def repeats_opener(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """`df` with opener (first word) and whether it equals the opener of the row before."""
    opener = F.lower(F.regexp_extract(value, "^[^\\p{L}\\p{N}]*([\\p{L}\\p{N}]+)", 1))
    out = df.withColumn("opener", opener)
    return out.withColumn("monotone", F.coalesce((F.col("opener") != "") & (F.lag("opener").over(Window.partitionBy(group).orderBy(order)) == F.col("opener")), F.lit(False)))


def _streamed(df: DataFrame, groups: list[str], order: str, fold, schema: str) -> DataFrame:
    """`fold` over the rows of each group in order, as they come: groups are dealt out, sorted on disk where need be, and a task holds the state of one group, never its rows."""
    rows = df.repartition(*groups).sortWithinPartitions(*groups, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols, out = {n: batch.column(n).to_pylist() for n in batch.schema.names}, []
            for i in range(batch.num_rows):
                own = tuple(cols[g][i] for g in groups)
                if own != key:
                    key, state = own, None
                state, value = fold(state, {n: c[i] for n, c in cols.items()})
                out.append(value)
            yield pa.record_batch([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_out"])

    return rows.mapInArrow(run, schema)


def greedy_pack(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """(group, order, size, pack): rows are added to a pack while their sizes sum to at most `limit`, then a new one begins."""

    def fold(state, row):
        (total, pack), n = state or (0, 0), row[size] or 0
        total, pack = (n, pack + 1) if total + n > limit and total > 0 else (total + n, pack)
        return (total, pack), pack

    own = df.select(group, order, size)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), "_out bigint"])
    return _streamed(own, [group], order, fold, schema).select(group, order, size, F.col("_out").cast("int").alias("pack"))


def unlink_repeats(df: DataFrame, group: str, order: str, target: str, within: int, reset: str | None = None) -> DataFrame:
    """(group, target, order, keep): a link is kept unless its target was kept in one of the `within` places before; a kept one starts the clock anew, and so does a new value of `reset`, as of a heading."""

    def fold(state, row):
        last, section = state or (None, None)
        if reset and row[reset] != section:
            last = None
        keep = last is None or row[order] - last > within
        return (row[order] if keep else last, row[reset] if reset else None), keep

    own = df.select(group, target, F.col(order).cast("long").alias(order), *([reset] if reset else []))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), "_out boolean"])
    return _streamed(own, [group, target], order, fold, schema).select(group, target, order, F.col("_out").alias("keep"))


def bounded_context(df: DataFrame, group: str, order: str, value: str, before: int = 2, words: int = 150) -> DataFrame:
    """`df` with the last `words` words of the `before` values that come before each row."""
    out = context(df, group, order, value, before)
    w = F.filter(F.split("context", "\\s+"), lambda x: x != "")
    return out.withColumn("context", F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - words + 1), F.greatest(F.lit(1), F.size(w))), " "))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """State after changes: for each key the last row by the order columns."""
    return latest(state.unionByName(changes), keys, *order)
