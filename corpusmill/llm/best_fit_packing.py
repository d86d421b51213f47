"""Packing of token sequences by patterns of lengths.

Lengths run from 0 to the sequence length, so their histogram has a fixed size.  On it, and
nowhere near the texts, patterns of one to three lengths that fill a sequence are enumerated,
non-negative least squares fits how often each is used, the counts are rounded down and held
to what the histogram has, and the lengths left over are packed best fit, longest first, again
by count.  The plan says for each length which ranks go to which run of sequences; texts
get their rank within their length and find their place there.

Null and empty texts give one piece that holds the closing id only, length 1, which is placed too.
Repeated rows are packed each on their own.  An empty table gives an empty result.

A special token's name in a text, such as <|endoftext|>, is one id where the tokenizer is used as it
is loaded; with special_as_text it is ordinary text, as documents may not speak for the engine.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, in_arrow, lowered, view, words

LIMIT = 2048
#: Distinct pieces of text whose ids a task remembers, and bytes of text that are cut at once.
REMEMBERED, AT_ONCE = 400_000, 2 << 20
#: Lower-case letters of ASCII and Latin-1 in UTF-8.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _flags(values: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Between units; ASCII letters; second bytes of Latin-1 letters, after 0xC3; marks that are neither letter, number nor apostrophe.
GAPS, LETTERS, SECONDS, MARKS = _flags(b" \n"), _flags(range(97, 123)), _flags([*range(0x9F, 0xB7), *range(0xB8, 0xC0)]), _flags(b".,|%#$&*!?;:")
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free character from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(_HIDDEN)}
_WORDS = np.array([BYTE_LEVEL.get(b, b) if b != 32 else b for b in range(256)], "<u4")  # words joined by spaces stay apart
#: Partners tried for each first length when patterns of three are enumerated.
PARTNERS = 6
SWEEPS = 30
#: Rows of one length that are ranked in one sort.
PART = 500_000

#: Texts on which tokenizers of other kinds differ.
PROBES = ["", " ", "Hello  World", "don't I'M we'll", "one,two;three", "a\tb\nc", "12345", "Caf\u00e9 cafe\u0301 \u65e5\u672c \U0001f389", "<|x|> #1 $2%", "UPPER lower MiXed"]

_TOKENIZERS: dict[tuple[str, bool], object] = {}


def _tokenizer(path: str, special_as_text: bool):
    if (path, special_as_text) not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = special_as_text
        _TOKENIZERS[path, special_as_text] = t
        # a tokenizer that looks across white space, keeps case or marks bytes otherwise is no tokenizer for the shortcut below
        if encode_texts([p.encode() for p in PROBES], path, {}, special_as_text) != [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(PROBES, add_special_tokens=False)]:
            del _TOKENIZERS[path, special_as_text]
            raise ValueError(f"{path} is no word-end byte-pair tokenizer without case and white space")
    return _TOKENIZERS[path, special_as_text]


def _encode_pieces(tok, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece.

    Normalising changes nothing in a word of lower-case letters and it is cut nowhere, so words go
    straight to the tokenizer's model.  All other pieces take the tokenizer's whole way.
    """
    at = [k for k, p in enumerate(pieces) if WORD(p)]
    out, model, rest = [b""] * len(pieces), tok.model, sorted(set(range(len(pieces))).difference(at))
    for k, e in zip(rest, tok.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False), strict=True):
        out[k] = np.array(e.ids, "<u4").tobytes()
    if at:
        letters = _WORDS[np.frombuffer(b" ".join([pieces[k] for k in at]), np.uint8)].tobytes().decode("utf-32-le")
        for k, w in zip(at, letters.split(" "), strict=True):
            out[k] = array("I", [t.id for t in model.tokenize(w)]).tobytes()
    return out


def _cut(data: np.ndarray, offs: np.ndarray, special_as_text: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case text, and where its pieces begin and end: units between spaces and line ends, or a word and the marks after it."""
    low = lowered(data)
    starts, ends, _ = words(low, offs, GAPS)
    if len(starts) == 0:
        return low, starts, ends
    if not special_as_text:
        signs = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for k in np.unique(np.searchsorted(starts, signs, "right") - 1).tolist():  # units with the sign that begins special tokens
            low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
    second = np.zeros(len(low), bool)
    second[1:] = (low[:-1] == 0xC3) & SECONDS[low[1:]]
    letter, mark = LETTERS[low] | second, MARKS[low]
    letter[:-1] |= second[1:]
    back = np.zeros(len(low), bool)
    back[1:] = mark[:-1] & letter[1:]
    back[starts] = False  # the mark ends another row
    simple = letter[starts] & ~np.logical_or.reduceat(back | ~(letter | mark | GAPS[low]), starts)
    turns = np.flatnonzero(letter[:-1] & mark[1:]) + 1
    unit = np.searchsorted(starts, turns, "right") - 1
    turns = turns[simple[unit] & (starts[unit] < turns)]
    return low, np.sort(np.concatenate([starts, turns]), kind="stable"), np.sort(np.concatenate([ends, turns]), kind="stable")


def encode(data: np.ndarray, offs: np.ndarray, path: str, known: dict[bytes, bytes], special_as_text: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (UTF-8, row by row at `offs`) and where each row's ids begin.

    The tokenizer drops white space, looks at nothing across it and ignores the case of A-Z, so a
    text's ids are those of the units between spaces and line ends, and those of a unit of letters
    with closing marks are the word's and the marks'; a piece met before is not encoded again while
    `known` holds it.  Only names of special tokens have a case, so units with the sign that begins
    them keep theirs.
    """
    tok = _tokenizer(path, special_as_text)
    low, starts, ends = _cut(data, offs, special_as_text)
    if len(starts) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    sizes = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(low[~GAPS[low]])]).dictionary_encode()
    code, (own, edges) = got.indices.to_numpy(zero_copy_only=False), view(got.dictionary)
    own, edges = own.tobytes(), edges.tolist()
    own = [own[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    ids = list(map(known.get, own))
    new = [k for k, x in enumerate(ids) if x is None]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    for k, x in zip(new, _encode_pieces(tok, [own[k] for k in new]), strict=True):
        known[own[k]] = ids[k] = x
    length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(length) - length
    n, place = length[code], np.zeros(len(code) + 1, np.int64)
    np.cumsum(n, out=place[1:])
    flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[code] - place[:-1], n) + np.arange(place[-1])]
    return flat, place[np.searchsorted(starts, offs)]


def encode_texts(texts: list[bytes], path: str, known: dict[bytes, bytes], special_as_text: bool = True) -> list[bytes]:
    """Ids of each text (UTF-8) as little-endian unsigned 32-bit values."""
    flat, at = encode(*view(pa.array(texts, pa.binary())), path, known, special_as_text)
    return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 0, keep_ids: bool = True, special_as_text: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text encoded, closed by `end_id`, cut only where longer than `limit`."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}  # of this task only: workers live on
        for batch in chunks(batches, "_text", AT_ONCE):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            flat, at = encode(*view(batch.column("_text")), tokenizer_path, known, special_as_text)
            for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                got = flat[a:b].tobytes() + end
                for k, a in enumerate(range(0, len(got), 4 * limit)):
                    part = got[a : a + 4 * limit]
                    doc.append(d)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).transform(in_arrow, cut_up, schema)


def enumerate_patterns(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, or nearly: singles, the best pair for each length, and triples with a few second lengths spread over the range."""
    lengths = np.unique(lengths[lengths > 0])[::-1]
    out = [(int(limit), 0, 0)] if limit in lengths else []

    def below(x: np.ndarray) -> np.ndarray:
        """The largest length that is at most x, or 0."""
        up = lengths[::-1]
        at = np.searchsorted(up, x, "right") - 1
        return np.where(at >= 0, up[np.maximum(at, 0)], 0)

    a = lengths[lengths < limit]
    b = below(limit - a)
    out += [(int(x), int(y), 0) for x, y in zip(a, b, strict=True) if 0 < y <= x]
    for k in range(1, PARTNERS + 1):
        rest = limit - a
        b = below(np.minimum(a, rest * k // (PARTNERS + 1)))
        c = below(np.maximum(rest - b, 0))
        out += [tuple(sorted((int(x), int(y), int(z)), reverse=True)) for x, y, z in zip(a, b, c, strict=True) if y > 0 and z > 0]
    return np.array(sorted(set(out), key=lambda p: (-sum(p), p)), np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent: min |sum_p x_p pattern_p - histogram| with x >= 0; longer lengths weigh more."""
    weight = np.arange(len(histogram)) / len(histogram)
    left = (histogram * 1.0).tolist()
    w = (weight * weight + 1e-3).tolist()
    parts = []
    for p in patterns.tolist():
        need: dict[int, int] = {}
        for length in p:
            if length:
                need[length] = need.get(length, 0) + 1
        parts.append((list(need.items()), sum(w[k] * m * m for k, m in need.items())))
    x = [0.0] * len(parts)
    for _ in range(sweeps):
        moved = 0.0
        for j, (need, norm) in enumerate(parts):
            step = max(-x[j], sum(w[k] * m * left[k] for k, m in need) / norm)
            if step:
                x[j] += step
                for k, m in need:
                    left[k] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def plan_packing(histogram: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """[(lengths in one sequence, how many such sequences)] that use up the histogram; index is the length."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[list[int], int]] = []
    left[0] = 0  # no length, no room: place() puts these at the start of the first sequence
    patterns = enumerate_patterns(np.flatnonzero(left), limit)
    if len(patterns):
        for p, x in zip(patterns.tolist(), fit_counts(patterns, left), strict=True):
            need = {k: p.count(k) for k in p if k}
            n = min(int(x), *(int(left[k]) // m for k, m in need.items()))
            if n > 0:
                plan.append(([k for k in p if k], n))
                for k, m in need.items():
                    left[k] -= m * n
    plan += best_fit(left, limit)
    return plan


def best_fit(left: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, on counts: open sequences are kept by free space as [lengths, how many]."""
    spaces: list[list[list]] = [[] for _ in range(limit + 1)]
    used = np.zeros(limit + 1, np.int64)  # open sequences by free space
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = np.flatnonzero(used[length:])
            if len(at) == 0:
                each = limit // length if n >= limit // length else n
                many = n // each
                spaces[limit - each * length].append([[length] * each, many])
                used[limit - each * length] += many
                n -= many * each
                continue
            free = length + int(at[0])
            content, many = spaces[free][-1]
            put = min(n, many)
            if put == many:
                spaces[free].pop()
            else:
                spaces[free][-1][1] -= put
            used[free] -= put
            spaces[free - length].append([[*content, length], put])
            used[free - length] += put
            n -= put
    return [(content, many) for level in spaces for content, many in level]


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the texts of a length go, in runs."""
    out, taken, seq = [], {}, 0
    for content, many in plan:
        at = 0
        for length in content:
            first = taken.get(length, 0)
            out.append((length, first, many, seq, at))
            taken[length] = first + many
            at += length
        seq += many
    return out


def pack(sequences: DataFrame, limit: int = LIMIT, length: str = "length") -> DataFrame:
    """`sequences` with sequence_id and offset; every row is placed, gapless from 0, at most `limit` in a sequence.

    `sequences` is read twice, so cut its lineage first where it is dear.  Only counts by
    length, at most limit + 1 of them, reach the driver.
    """
    spark = sequences.sparkSession
    counts = sequences.groupBy(length).agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(limit + 1, np.int64)
    for row in counts:
        histogram[row[0]] += row["n"]
    plan = slots(plan_packing(histogram, limit))
    # rank within a length in parts of about PART rows, so that a length that many rows share is not sorted as one group
    parts = spark.createDataFrame([(int(r[0]), 1 + r["n"] // PART) for r in counts] or [(0, 1)], f"`{length}` long, _parts long")  # limit + 1 rows at most
    salted = sequences.join(F.broadcast(parts), length).withColumn("_salt", F.pmod(F.xxhash64(*sequences.columns[:2]), F.col("_parts")))
    sizes = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(length, "_salt").orderBy(*sequences.columns[:2])
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1)
    # sizes has limit + 1 rows and one more for each PART rows
    ranked = ranked.join(sizes, [length, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*sequences.columns, "_rank")
    return place(ranked, plan, length).drop("_rank")


def place(ranked: DataFrame, plan: list[tuple[int, int, int, int, int]], length: str) -> DataFrame:
    by: dict[int, list] = {}
    for row in plan:
        by.setdefault(row[0], []).append(row[1:])
    table = {k: np.array(v, np.int64).T for k, v in by.items()}
    fields = [f for f in ranked.schema.fields]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (length, "_rank"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for k in np.unique(n):
                own = np.flatnonzero(n == k)
                if k == 0:
                    continue
                first, _, start, at = table[int(k)]
                run = np.searchsorted(first, rank[own], "right") - 1
                seq[own] = start[run] + rank[own] - first[run]
                off[own] = at[run]
            yield pa.record_batch([*batch.columns, pa.array(seq), pa.array(off)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    return ranked.transform(in_arrow, put, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 0, keep_ids: bool = True, special_as_text: bool = True) -> DataFrame:
    """Encode `docs`, cut what is too long, and place every piece; with keep_ids the token ids come along."""
    return pack(cut(pieces(docs, tokenizer_path, limit, end_id, keep_ids, special_as_text)), limit)
