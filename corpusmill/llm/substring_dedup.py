"""Removal of repeated word windows with difference-cover anchors.

Slices of words are hashed only at places whose number modulo the period lies in a difference
cover.  For any two equal windows some shift makes both places covered at once, so they share an
aligned anchor; repeated anchors are then extended to the windows around them, and every word that
a repeated window covers goes.

Words are [^\\x20\\x09-\\x0D]+ of the whole text; a null text has none.  Texts shorter than a window
are left as they are.  A window repeated inside one text counts, as do repeated rows.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mixed, runs, view, words
from .repeats import SHORT, Sequences, covered, find_repeats

WINDOW = 35
#: {0, 1, 4, 14, 16} modulo 21: every difference modulo 21 occurs once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def _places(window: int):
    anchor = window - PERIOD + 1
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def places(x: Sequences) -> np.ndarray:
        """Covered places of texts that hold a window, with room for an anchor."""
        n = np.diff(x.offs)
        own = np.repeat(n, n)
        at = np.arange(len(own)) - np.repeat(x.offs[:-1], n)
        return np.flatnonzero(in_cover[at % PERIOD] & (at + anchor <= own) & (own >= window))

    return places


def _extend(window: int):
    reach = window - (window - PERIOD + 1)

    def solve(seed: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        """For each shift, the windows through the anchors of all groups at once: those that two rows share are repeats."""
        n = len(seed)
        lpad, llen = _padded(*left, reach)
        rpad, rlen = _padded(*right, window)
        lmax, rmax = np.zeros(n, np.int64), np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            lh, rh = _folds(lpad), _folds(rpad)
            group = mixed(seed.view(np.uint64))
            for o in range(reach + 1):
                rows = np.flatnonzero((llen >= o) & (rlen >= window - o))
                key = mixed(group[rows] ^ mixed(lh[rows, o] + np.uint64(o)) * np.uint64(3)) + rh[rows, window - o]
                order = np.argsort(key, kind="stable")
                at = runs(key[order])
                size = np.diff(at)
                hit = rows[order[np.repeat(size > 1, size)]]
                lmax[hit] = np.maximum(lmax[hit], o)
                rmax[hit] = np.maximum(rmax[hit], window - o)
        return lmax, rmax

    return solve


def _padded(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    units, offs = np.frombuffer(data.tobytes(), np.uint64), offs // SHORT
    n = np.diff(offs)
    out = np.zeros((len(n), width), np.uint64)
    col = np.arange(len(units)) - np.repeat(offs[:-1], n)
    out[np.repeat(np.arange(len(n)), n), col] = units
    return out, n


def _folds(units: np.ndarray) -> np.ndarray:
    """Hash of the first k units of each row, for every k."""
    out = np.zeros((units.shape[0], units.shape[1] + 1), np.uint64)
    for k in range(units.shape[1]):
        out[:, k + 1] = mixed(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + units[:, k] + np.uint64(1))
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, text: the kept words joined by one space."""
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD}")
    seed = window - PERIOD + 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offs = view(batch.column("text"))
            starts, ends, first = words(data, offs)
            raw = data.tobytes()
            cols = [[], [], [], []]
            for i, (settled, spans) in enumerate(zip(batch.column("settled").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                a, b = int(first[i]), int(first[i + 1])
                keep = np.ones(b - a, bool) if settled is None else ~covered(b - a, settled, spans, window, seed)
                w = np.flatnonzero(keep) + a
                kept = b" ".join([raw[x:y] for x, y in zip(starts[w].tolist(), ends[w].tolist(), strict=True)])
                for c, v in zip(cols, (b - a, b - a - len(w), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    c.append(v)
            out = [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(cols[3], pa.string())], [*names, "text"]
            yield pa.record_batch(out, names=names)

    found = find_repeats(docs, "words", window, seed, _places(window), _extend(window))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "settled", "spans").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)
