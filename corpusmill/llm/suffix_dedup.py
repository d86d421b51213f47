"""Removal of repeated byte strings with an enhanced suffix array.

Suffixes start at anchors only: of the hashes of all seed-long slices in a window, the smallest
names the anchor, so equal windows share one.  Suffixes with an anchor in common that are not
settled by equal contexts are sorted (Spark's external sort), neighbours give the common-prefix
array, and a stack scan walks its interval tree bottom up.  When two intervals meet, their left
extensions are compared in sorted order: diverse ones stop there, equal ones reach further; each
occurrence in the interval, not just neighbours, learns how far its repeat reaches.

Bytes are those of the whole text in UTF-8; a null text is empty.  Texts shorter than `length`
bytes are left as they are.  Matches stay inside a text; a string repeated inside one text counts,
as do repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, in_arrow, mixed, runs, view
from .repeats import Sequences, covered, find_repeats

LENGTH = 400


def _block_extreme(x: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over every `width` consecutive values, by running extremes of blocks from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    b = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    fore = ufunc.accumulate(b, axis=1).ravel()
    back = ufunc.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[:n], fore[width - 1 : width - 1 + n])


def _places(length: int, seed: int):
    width, top = length - seed + 1, np.uint64(0xFFFFFFFFFFFFFFFF)

    def places(x: Sequences) -> np.ndarray:
        """Seeds whose hash is the smallest in some window that holds them."""
        total = len(x.units)
        if total < length:
            return np.zeros(0, np.int64)
        h = mixed((x.sums[seed:] - x.sums[:-seed]) * x.roll.down[: total - seed + 1])
        n = np.diff(x.offs)
        room = np.repeat(x.offs[1:], n) - np.arange(total)  # units from here to the end of the text
        h[room[: len(h)] < seed] = top
        low = _block_extreme(h, width, np.minimum, top)  # of the window that begins at each place
        low[room[: len(low)] < length] = 0
        edge = np.zeros(width - 1, np.uint64)
        high = _block_extreme(np.concatenate([edge, low, edge]), width, np.maximum, 0)  # of the windows that hold each seed
        return np.flatnonzero((high == h) & (room[: len(h)] >= seed))

    return places


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def interval_tree(right: list[bytes], left: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """Left and right reach of each of the sorted suffixes `right`, whose reversed left contexts are `left`."""
    n = len(right)
    l_reach, r_reach = [0] * n, [0] * n
    order = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k

    def meet(i: int, j: int, depth: int) -> None:
        l = _common(left[i], left[j])
        if l + depth >= length:
            for k in (i, j):
                l_reach[k] = max(l_reach[k], l)
                r_reach[k] = max(r_reach[k], depth)

    def merged(a: list[int], b: list[int], depth: int) -> list[int]:
        """Join two sets of ranks below one interval: every new neighbour in left order is the best partner at this depth."""
        if len(a) < len(b):
            a, b = b, a
        for k in b:
            at = bisect_left(a, k)
            if at:
                meet(order[a[at - 1]], order[k], depth)
            if at < len(a):
                meet(order[a[at]], order[k], depth)
            a.insert(at, k)
        return a

    open_intervals: list[tuple[int, list[int]]] = []
    last = [rank[0]]
    for i in range(1, n):
        depth = _common(right[i - 1], right[i])
        while open_intervals and open_intervals[-1][0] > depth:
            d, members = open_intervals.pop()
            last = merged(members, last, d)
        if open_intervals and open_intervals[-1][0] == depth:
            d, members = open_intervals.pop()
            last = merged(members, last, d)
        open_intervals.append((depth, last))
        last = [rank[i]]
    while open_intervals:
        d, members = open_intervals.pop()
        last = merged(members, last, d)
    return l_reach, r_reach


def _scan(length: int):
    def solve(seed: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        l_reach, r_reach = np.zeros(len(seed), np.int64), np.zeros(len(seed), np.int64)
        (ld, lo), (rd, ro) = ((d.tobytes(), o.tolist()) for d, o in (left, right))
        at = runs(seed)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 1:
                l_reach[a:b], r_reach[a:b] = interval_tree([rd[ro[i] : ro[i + 1]] for i in range(a, b)], [ld[lo[i] : lo[i + 1]] for i in range(a, b)], length)
        return l_reach, r_reach

    return solve


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (the bytes that stay)."""
    seed = length // 2

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offs = view(batch.column("text"))
            cols = [[], [], [], [], []]
            for i, (settled, spans) in enumerate(zip(batch.column("settled").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                own = data[offs[i] : offs[i + 1]]
                gone = np.zeros(len(own), bool) if settled is None else covered(len(own), settled, spans, length, seed)
                kept = own[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                for c, v in zip(cols, (len(own), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            out = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(cols[4], pa.binary())], [*names, "kept"]
            yield pa.record_batch(out, names=names)

    found = find_repeats(docs, "bytes", length, seed, _places(length, seed), _scan(length))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "settled", "spans").transform(in_arrow, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated byte strings taken out of text (characters that lose a byte go too); n_chars follows where there is one.

    A null text becomes an empty one; repeated rows lose all of a text of `length` bytes or more; an
    empty table gives an empty one.
    """
    seed, others = length // 2, [c for c in docs.columns if c != "text"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offs = view(batch.column("text"))
            texts = []
            for i, (settled, spans) in enumerate(zip(batch.column("settled").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                own = data[offs[i] : offs[i + 1]]
                if settled is not None:
                    own = own[~covered(len(own), settled, spans, length, seed)]
                texts.append(own.tobytes().decode(errors="ignore"))
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    found = find_repeats(docs, "bytes", length, seed, _places(length, seed), _scan(length), columns=others)
    schema = T.StructType([T.StructField("row", found.schema["row"].dataType), T.StructField("text", T.StringType())])
    out = found.transform(in_arrow, cut_out, schema)
    out = out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
