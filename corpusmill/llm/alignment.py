"""Alignment of two tokenizers: which tokens of one stand for which tokens of the other, and how often.

Both tokenizers cut at a single space between two visible characters, so text is encoded and aligned in
units between such spaces, each distinct unit of a batch once.  A document's links go out as packed rows, one per
batch of documents and stripe of first ids.  Stripes are counted in dense blocks with np.add.at, whose
row maxima tell the best partner; the blocks then go to where the links of their stripe lie, which are
scored there, and the scores come together again by batch.

Null and empty texts, and texts whose tokens do not spell them, have no tokens: their numbers are 0 and
their groups ''.  Texts of any length are encoded whole.  Repeated rows are documents of their own.  All
partners that share the highest count are best.  An empty table gives an empty result.  Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, from_planes, owners, planes, runs, stored

#: First ids in one dense block.
BLOCK_ROWS = 64
#: Text of one batch of documents, units encoded in one go, links of a group that are written out place by place, and links gathered before they are counted.
BATCH_BYTES, BLOCK_UNITS, EXPANDED, GATHERED = 4 << 20, 2000, 4096, 1 << 22
#: Batches whose links of one stripe are scored together.
SCORED = 512

#: A byte-level vocabulary writes a byte that is no visible Latin-1 character as the next free character from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE = {chr(b): b for b in range(256) if b not in _HIDDEN} | {chr(256 + k): b for k, b in enumerate(_HIDDEN)}


class Units(NamedTuple):
    """What is known of distinct units: their own numbers, and their links and groups one unit after the other."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_pairs: np.ndarray
    pairs: np.ndarray  # a * size_b + b
    times: np.ndarray
    groups: list[bytes]


class Pair:
    """Two tokenizers and their ids as bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.size_a = max(vocab.values()) + 1
        self.bytes_a = [b""] * self.size_a
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(_BYTE[c] for c in token) if all(c in _BYTE for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} has pieces that go on after a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.most = max(self.size_a, self.size_b)
        self.written = [f"{i}{end}".encode() for end in ",|;\n" for i in range(self.most)]

    def _encoded(self, blocks: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides, or None where they do not spell the block.  A block begins with the space that the second tokenizer adds by itself."""
        texts = [x.decode() for x in blocks]
        first, second = self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1)
        both = [(e.ids, y) for e, y in zip(first, second, strict=True)]
        return [(x, y) if b"".join(map(self.bytes_a.__getitem__, x)) == t == b"".join(map(self.bytes_b.__getitem__, y)) else None for t, (x, y) in zip(blocks, both, strict=True)]

    def units(self, units: list[bytes], safe: np.ndarray) -> Units:
        """Units that are `safe` begin and end as unit_starts cuts, so many are encoded in one go; the others, and blocks that are not spelled, unit by unit."""
        order = np.argsort(~safe, kind="stable")
        n = int(safe.sum())
        spans = [(x, min(x + BLOCK_UNITS, n)) for x in range(0, n, BLOCK_UNITS)] + [(x, x + 1) for x in range(n, len(units))]
        own = [units[k] for k in order.tolist()]
        ids_a, ids_b, sound = [], [], np.ones(len(units), bool)
        for (x, y), ids in zip(spans, self._encoded([b"".join(own[x:y]) for x, y in spans]), strict=True):
            for k, got in [(x, ids)] if ids else enumerate(self._encoded(own[x:y]), x):
                if got:
                    ids_a.append(np.array(got[0], np.int64))
                    ids_b.append(np.array(got[1], np.int64))
                else:
                    sound[k] = False
        held = order[sound]
        got = self.aligned(*(np.concatenate(i) if i else np.zeros(0, np.int64) for i in (ids_a, ids_b)), np.array([len(units[k]) for k in held.tolist()], np.int64))
        # back into the order of `units`: the places of unsound ones stay 0
        at = np.full(len(units), -1)
        at[held] = np.arange(len(held))
        there = at >= 0
        numbers = [np.where(there, x[at], 0) if len(x) else np.zeros(len(units), np.int64) for x in got[1:5]]
        begin = np.cumsum(got.n_pairs) - got.n_pairs
        source = _ranges(begin[at[there]], got.n_pairs[at[there]])
        return Units(there, *numbers, got.pairs[source], got.times[source], [got.groups[k] if k >= 0 else b"" for k in at.tolist()])

    def aligned(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> Units:
        """Groups end where tokens of both sides end; within a group all are linked with all."""
        n = len(sizes)
        if n == 0:
            return Units(*(np.zeros(0, np.int64) for _ in range(7)), [])
        end_a, end_b, end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), np.cumsum(sizes)
        common = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
        if (common[np.searchsorted(common, end)] != end).any():
            raise ValueError("a tokenizer has tokens that go on after a space between two characters")
        group_a, group_b, unit = np.searchsorted(common, end_a), np.searchsorted(common, end_b), np.searchsorted(end, common)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        size = many_a * many_b
        small = np.flatnonzero(size <= EXPANDED)
        place = _ranges(np.zeros(len(small), np.int64), size[small])
        wide = np.repeat(many_b[small], size[small])
        keys = a[np.repeat(first_a[small], size[small]) + place // wide] * self.size_b + b[np.repeat(first_b[small], size[small]) + place % wide]
        of, times = np.repeat(unit[small], size[small]), np.ones(len(keys), np.int64)
        for g in np.flatnonzero(size > EXPANDED).tolist():  # distinct ids of a long group, not all its places
            xs, nx = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            ys, ny = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            keys = np.append(keys, np.add.outer(xs * self.size_b, ys).ravel())
            times = np.append(times, np.multiply.outer(nx, ny).ravel())
            of = np.append(of, np.full(len(xs) * len(ys), unit[g]))
        order = np.argsort(of, kind="stable")
        # each token with the sign after it: in its group, after its side, after its group, after its unit
        last = np.append(unit[1:] != unit[:-1], True)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[first_a + many_a - 1] = 1
        sign_b[first_b + many_b - 1] = np.where(last, 3, 2)
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + first_b[group_a]] = sign_a * self.most + a
        written[np.arange(len(b)) + (first_a + many_a)[group_b]] = sign_b * self.most + b
        groups = b"".join(map(self.written.__getitem__, written.tolist())).split(b"\n")[:-1]
        count = [np.bincount(x, minlength=n) for x in (unit[group_a], unit[group_b], unit, of)]
        return Units(np.ones(n, bool), count[0], count[1], count[2], count[3], keys[order], times[order], groups)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each, `size` places long, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end, and bytes that begin, a character that surely is no white space.

    Sure are visible ASCII, characters of two bytes from U+00C0 on, and of those that begin lead bytes of longer ones from U+4000 on.
    """
    visible = (data > 0x20) & (data < 0x7F)
    ends = visible.copy()
    ends[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return ends, visible | ((data >= 0xC3) & (data < 0xE0)) | (data >= 0xE4)


def unit_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin: at each text, and at every single space between two sure characters; and which of them begin and end like that."""
    n = len(data)
    ends, begins = _sure(data)
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = (data[1:-1] == 0x20) & ends[:-2] & begins[2:]
    inner[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(inner)
    stops = np.append(starts[1:], n)
    safe = (stops - starts > 1) & begins[np.minimum(starts + 1, max(n - 1, 0))] & ends[stops - 1] if n else np.zeros(0, bool)
    return starts, safe


_ROW = pa.schema([
    ("batch", pa.int64()), ("stripe", pa.int32()), ("n", pa.int64()), ("data", pa.binary()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]))),
])
_SCHEMA = "batch long, stripe int, n long, data binary, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string>>"


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begins = runs(keys)[:-1]
    return keys[begins], np.add.reduceat(values, begins) if len(begins) else values


def _batch(pair: Pair, batch: pa.RecordBatch, number: int, stripes: int, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    texts = [b" " + t if t else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    count, data = len(texts), np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, safe = unit_starts(data, offs)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.zeros(len(coded.dictionary), bool)
    distinct[which] = safe
    units = pair.units(coded.dictionary.to_pylist(), distinct)
    doc = owners(np.searchsorted(starts, offs))
    sound = np.ones(count, bool)
    sound[doc[~units.sound[which]]] = False
    which, doc = which[sound[doc]], doc[sound[doc]]

    def per_doc(numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(count, np.int64)
        np.add.at(out, doc, numbers[which])
        return out

    joined, sha, at = [], [], np.searchsorted(doc, np.arange(count + 1))
    for k in range(count):
        own = b";".join([units.groups[w] for w in which[at[k] : at[k + 1]].tolist()])
        sha.append(hashlib.sha256(own).hexdigest() if own else "")
        joined.append(own.decode() if keep_groups else None)
    # every unit's pairs, once for each place of the unit
    many = units.n_pairs[which]
    source = _ranges((np.cumsum(units.n_pairs) - units.n_pairs)[which], many)
    keys, times = units.pairs[source], units.times[source]
    links = np.zeros(count, np.int64)
    local = np.repeat(doc, many)
    np.add.at(links, local, times)
    columns = [batch.column("doc_id"), *(pa.array(per_doc(x)) for x in (units.n_a, units.n_b, units.n_groups)), pa.array(links), pa.array(sha, pa.string()), pa.array(joined, pa.string())]
    rows = pa.StructArray.from_arrays(columns, names=[f.name for f in _ROW.field("docs").type.value_type])
    yield pa.record_batch([pa.array([number]), pa.array([-1], pa.int32()), pa.array([count], pa.int64()), pa.array([b""], pa.binary()), pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), rows)], schema=_ROW)
    if len(keys) == 0:
        return
    cells = pair.size_a * pair.size_b
    keys, times = _summed(local * cells + keys, times)
    local, a, b = keys // cells, keys % cells // pair.size_b, keys % pair.size_b
    stripe = a % stripes
    order = np.argsort(stripe, kind="stable")
    stripe, local, times, cell = stripe[order], local[order], times[order], ((a // stripes) * pair.size_b + b)[order]
    edges = runs(stripe)
    data = [planes(local[x:y].astype("<u4")) + planes(cell[x:y].astype("<u4")) + planes(times[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    n = len(data)
    yield pa.record_batch([pa.array([number] * n, pa.int64()), pa.array(stripe[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges)), pa.array(data, pa.binary()), pa.nulls(n, _ROW.field("docs").type)], schema=_ROW)


def _pairs_of(row_data: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(row_data.as_buffer())
    return from_planes(data, "<u4", n), from_planes(data[4 * n :], "<u4", n), from_planes(data[8 * n :], "<i8", n)


_COUNT = pa.schema([("stripe", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per cell, summed over what a task reads: one packed row per stripe."""
    keys, counts, size = [], [], 0

    def fold(out: bool) -> Iterator[pa.RecordBatch]:
        nonlocal keys, counts, size
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        keys, counts, size = [k], [c], len(k)
        if (out or size > GATHERED // 2) and size:
            edges = runs(k >> 32)
            data = [planes((k[x:y] & 0xFFFFFFFF).astype("<u4")) + planes(c[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([pa.array((k >> 32)[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges)), pa.array(data, pa.binary())], schema=_COUNT)
            keys, counts, size = [], [], 0

    for batch in batches:
        for stripe, n, data in zip(batch.column("stripe").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
            cell = from_planes(memoryview(data.as_buffer())[4 * n :], "<u4", n)
            keys.append((np.int64(stripe) << 32) + cell.astype(np.int64))
            counts.append(np.ones(n, np.int64))
            size += n
            if size > GATHERED:
                yield from fold(False)
    if keys:
        yield from fold(True)


def _blocks(stripes: int, size_a: int, size_b: int):
    height = -(-size_a // stripes)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each stripe's dense block: its cells that are not 0, and whether they are the highest of their row."""
        dense, now = np.zeros(height * size_b, np.int64), None

        def out() -> pa.RecordBatch:
            cell = np.flatnonzero(dense)
            count = dense[cell]
            best = count == dense.reshape(height, size_b).max(axis=1)[cell // size_b]
            dense[cell] = 0
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([len(cell)]), pa.array([planes(cell.astype("<u4")) + planes(count) + best.tobytes()], pa.binary())], schema=_COUNT)

        for batch in batches:
            for stripe, n, data in zip(batch.column("stripe").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
                if now is not None and stripe != now:
                    yield out()
                now, data = stripe, memoryview(data.as_buffer())
                np.add.at(dense, from_planes(data, "<u4", n), from_planes(data[4 * n :], "<i8", n))
        if now is not None:
            yield out()

    return blocks


_SCORE = pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _score(stripes: int, size_a: int, size_b: int):
    cells = -(-size_a // stripes) * size_b

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe's counts come first, then its links, batch by batch: per document the best links and the sum of counts."""
        dense, best, filled = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(0, np.uint32)
        for group in batches:
            number, many, packed = [], [], []
            for batch, n, data in zip(group.column("batch").to_pylist(), group.column("n").to_pylist(), group.column("data"), strict=True):
                if batch is None:
                    dense[filled], best[filled] = 0, False
                    buf = memoryview(data.as_buffer())
                    filled = from_planes(buf, "<u4", n)
                    dense[filled], best[filled] = from_planes(buf[4 * n :], "<i8", n), np.frombuffer(buf[12 * n :], bool)
                    continue
                local, cell, times = _pairs_of(data, n)
                begins = runs(local)[:-1]
                sums = np.add.reduceat(dense[cell] * times, begins)
                good = np.add.reduceat(best[cell] * times, begins)
                number.append(batch)
                many.append(len(begins))
                packed.append(planes(local[begins]) + planes(good) + planes(sums))
            if number:
                yield pa.record_batch([pa.array(number, pa.int64()), pa.array(many, pa.int64()), pa.array(packed, pa.binary())], schema=_SCORE)

    return score


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
_LONGS = ["n_best", "count_sum"]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's documents come first, then their scores from all stripes."""
    docs, best, sums = None, None, None

    def out() -> pa.RecordBatch:
        return pa.record_batch([*(docs.field(n) for n in _OUT), pa.array(best), pa.array(sums)], names=[*_OUT, *_LONGS])

    for batch in batches:
        for n, data, own in zip(batch.column("n").to_pylist(), batch.column("data"), batch.column("docs"), strict=True):
            if own.is_valid:
                if docs is not None:
                    yield out()
                docs, best, sums = own.values, np.zeros(n, np.int64), np.zeros(n, np.int64)
                continue
            buf = memoryview(data.as_buffer())
            local = from_planes(buf, "<u4", n)
            best[local] += from_planes(buf[4 * n :], "<i8", n)
            sums[local] += from_planes(buf[12 * n :], "<i8", n)
    if docs is not None:
        yield out()


class Alignment:
    """The links of all documents, written once, and what is read from them."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False):
        pair = Pair(path_a, path_b)
        self.size_a, self.size_b = pair.size_a, pair.size_b
        self.stripes = stripes = -(-pair.size_a // BLOCK_ROWS)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, number = Pair(path_a, path_b), TaskContext.get().partitionId() << 32
            for batch in chunks(batches, most=BATCH_BYTES):
                yield from _batch(own, batch, number, stripes, keep_groups)
                number += 1

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.rows = stored(rows.mapInArrow(encode, _SCHEMA))
        self.links = self.rows.filter("stripe >= 0").select("batch", "stripe", "n", "data")
        counted = self.links.select("stripe", "n", "data").mapInArrow(_count, "stripe int, n long, data binary")
        self.blocks = cut(counted.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_blocks(stripes, pair.size_a, pair.size_b), "stripe int, n long, data binary"))

    def pairs(self) -> DataFrame:
        """(a, b, count, best): in how many documents two ids are linked, and whether that is the highest count of the first one."""
        stripes, size_b = self.stripes, self.size_b

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, n, data in zip(batch.column("stripe").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
                    buf = memoryview(data.as_buffer())
                    cell = from_planes(buf, "<u4", n).astype(np.int64)
                    yield pa.record_batch([pa.array(cell // size_b * stripes + stripe), pa.array(cell % size_b), pa.array(from_planes(buf[4 * n :], "<i8", n)), pa.array(np.frombuffer(buf[12 * n :], bool))], names=["a", "b", "count", "best"])

        return self.blocks.mapInArrow(spread, "a long, b long, count long, best boolean")

    def documents(self) -> DataFrame:
        """Per document its numbers of tokens, groups and links, the groups, and the scores of its links."""
        numbers = self.rows.filter("stripe < 0").select("batch", "n", "data", "docs")
        salts = max(1, -(-numbers.count() // SCORED))
        # a stripe is parted by batch, so one id on a third of all links is no single task
        links = self.links.select("batch", "stripe", F.pmod(F.xxhash64("batch"), F.lit(salts).cast("long")).alias("salt"), "n", "data")
        blocks = self.blocks.select(F.lit(None).cast("long").alias("batch"), "stripe", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"), "n", "data")
        both = links.unionByName(blocks).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("batch"))
        scores = both.select("batch", "n", "data").mapInArrow(_score(self.stripes, self.size_a, self.size_b), "batch long, n long, data binary")
        both = numbers.unionByName(scores, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", F.col("docs").isNull())
        return both.mapInArrow(_gather, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, where kept, groups ('a1,a2|b1;a3|b2,b3')."""
    out = Alignment(docs, path_a, path_b, keep_groups).documents()
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *_LONGS, "groups_sha256", *(["groups"] if keep_groups else []))
