"""Exact token counts from one histogram of encoded lengths.

Texts are encoded in tasks, the lengths are aggregated to one row per distinct length, and
running sums from the longest length down answer, for every context limit, how many tokens
there are in all, how many remain when each text is cut at the limit, and any quantile.

Null and empty texts have length 0.  Repeated rows count each time.  An empty table gives an
empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Lengths per block of the two-level running sums.
BLOCK = 4096

_ENCODERS: dict[str, object] = {}


def _encoder(path: str, pattern: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, keys: list[str] | None = None) -> DataFrame:
    """One row per text: `keys` and n_tokens."""
    keys = keys or []
    fields = [f for f in docs.select(*keys).schema.fields] if keys else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_path, pattern)
        for batch in batches:
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in batch.column("_text"))], pa.int64())
            yield pa.record_batch([*(batch.column(k) for k in keys), n], names=[*keys, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long"])
    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(measure, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length, summed before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """Per length L as a context limit: texts and tokens of that length, texts that are longer, tokens when every text is cut at L, and all tokens.

    The histogram is read twice, so it is written once.  Running sums in two levels: over blocks of lengths, then inside each block.
    """
    h = cut(histogram).select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    up = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(up), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("tokens_above"), F.sum("bd").over(Window.partitionBy()).alias("all_docs"), F.sum("bt").over(Window.partitionBy()).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_longer"),
    )
    truncated = F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", truncated.alias("tokens_truncated"), ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_at_most"), "all_docs", "all_tokens")


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens that remain when every text is cut at `limit`."""
    return int(histogram.agg(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs"))).first()[0] or 0)


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share q of texts does not exceed."""
    row = limit_table(histogram).filter(F.col("share_at_most") >= q).agg(F.min("n_tokens")).first()
    return None if row is None or row[0] is None else int(row[0])
