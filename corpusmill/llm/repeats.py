"""Long repeats across a corpus: the stages that substring and suffix-array dedup share.

A sequence is a text's words or its bytes; a window is `window` consecutive units.  A seed is a
shorter slice chosen so that two equal windows, wherever they lie, hold an equal seed at the
same place.  The stages:

1. Tasks hash the seeds, and of each the whole context in which windows through it can lie, with
   the seed's place in it.
   Seeds travel as packed arrays, one per bucket of the hash space, with repeats inside a batch
   of texts already folded together.  A seed with many contexts in a batch is dealt out by context.
2. In a bucket, a seed whose whole context occurs again is settled: all of it is repeated.  A
   seed that occurs again in other contexts is left open, and each distinct context of it is
   fetched once from its text.
3. Open seeds are solved by group (see `Solver`): how far to the left and right of each do
   repeated windows reach.  A seed with more than COUNT contexts is no group: its windows are
   counted by hash instead.
4. Spans are gathered for each text.

Rows are told apart by a hash of (doc_id, text), so repeated rows count as two occurrences and
null ids do no harm.  Places of repeated rows are the same, so lists of them are gathered as sets:
a row that is a third of the table has no longer lists than a single one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, OTHER, WORDS, bucket_count, chunks, cut, from_planes, grouped, in_arrow, mixed, planes, row_key, runs, stored, text_rows, view, words

#: Bytes of a word's hash in a context.
SHORT = 8
#: Bytes of text behind one bucket of seeds.
BUCKET = 16 << 20
#: Seeds folded together at once before they are sent out.
FOLD = 400_000

SEED = np.dtype([("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("flag", "u1")])
#: Flags of a seed: its context recurs in its batch; its seed is common there; it only stands for common ones.
MANY, COMMON, STAND_IN = 1, 2, 4
#: Contexts of one seed in a batch from which they are dealt out by context, and in the corpus from which windows are counted instead of compared.
DEAL, COUNT = 64, 65_536
OPEN = np.dtype([("h", "<u8"), ("pos", "<i4"), ("alone", "?")])


class Sequences:
    """The unit sequences of a batch: offsets by row, and prefix sums for hashing slices."""

    def __init__(self, batch: pa.RecordBatch, kind: str):
        self.doc = batch.column("rid").to_numpy(zero_copy_only=False)
        self.data, self.byte_offs = view(batch.column("text"))
        if kind == "bytes":
            self.offs, self.units, self.short = self.byte_offs, self.data, self.data
            self.sums, self.more = BYTES.sums(self.data), OTHER.sums(self.data)
            self.roll, self.roll2 = BYTES, OTHER
        else:
            self.starts, self.ends, self.offs = words(self.data, self.byte_offs)
            text = BYTES.sums(self.data)
            self.units = BYTES.slices(text, self.starts, self.ends)
            self.short = np.ascontiguousarray(self.units.view(np.uint8).reshape(-1, 8)[:, :SHORT])
            self.sums, self.more = WORDS.sums(self.units), OTHER.sums(mixed(self.units ^ np.uint64(0x9E3779B97F4A7C15)))
            self.roll, self.roll2 = WORDS, OTHER

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.roll.slices(self.sums, begin, end)

    def contexts(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.roll2.slices(self.more, begin, end)


#: places(sequences) gives the first units of all seeds in a batch, ascending.
Places = Callable[[Sequences], np.ndarray]
#: solve(seed, left contexts, right contexts) gives for each row how far left and right repeated windows
#: through its seed reach (0, 0: none); contexts are (bytes, offsets), rows sorted by seed and right context.
Solver = Callable[[np.ndarray, tuple, tuple], tuple[np.ndarray, np.ndarray]]


def _emit(kind: str, window: int, seed: int, places: Places, buckets: int):
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(held)
        s = s[np.lexsort((s["f"], s["h"]))]
        at = runs(s["h"], s["f"])
        n = np.diff(at)
        again = np.repeat(n > 1, n)
        doc, pos = s["doc"][again], s["pos"][again]
        s = s[at[:-1]]
        s["flag"][n > 1] |= MANY
        # a common seed is dealt out by its contexts; one row stands in for them where the seed's other rows go
        at = runs(s["h"])
        n = np.diff(at)
        stand_in = s[at[:-1]][n > DEAL]
        stand_in["f"], stand_in["flag"] = 0, STAND_IN
        s["flag"][np.repeat(n > DEAL, n)] |= COMMON
        s = np.concatenate([s, stand_in])
        s = s[np.lexsort((s["f"], s["h"]))] if len(stand_in) else s
        to = np.where(s["flag"] & COMMON, mixed(s["h"] ^ s["f"]), s["h"])
        bucket = ((to >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        s, bucket = s[order], bucket[order]
        at = runs(bucket)
        rows = [(int(bucket[a]), None, _packed(s[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        for d, p in _by_doc(doc, pos):
            rows.append((d % buckets, d, np.unique(p).astype("<i4").tobytes()))
        for i in range(0, len(rows), 4096):
            b, d, p = zip(*rows[i : i + 4096], strict=True)
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(d, pa.int64()), pa.array(p, pa.binary())], names=["bucket", "doc", "payload"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chunks(batches):
            x = Sequences(batch, kind)
            at = places(x)
            if len(at) == 0:
                continue
            row = np.searchsorted(x.offs, at, "right") - 1
            out = np.zeros(len(at), SEED)
            out["h"] = x.hashes(at, at + seed)
            begin = np.maximum(at - (window - seed), x.offs[row])
            # the seed's place in its context is part of f: seeds at two places of one clipped context are no second occurrence of it
            out["f"] = mixed(x.contexts(begin, np.minimum(at + window, x.offs[row + 1])) + (at - begin).astype(np.uint64))
            out["doc"], out["pos"] = x.doc[row], at - x.offs[row]
            held.append(out)
            n += len(at)
            if n >= FOLD:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    return emit


def _by_doc(doc: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cols = [c[order] for c in cols]
    at = runs(doc)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(doc[a]), *(c[a:b] for c in cols)


def _packed(s: np.ndarray) -> bytes:
    """Seeds of one bucket, sorted by hash: hashes as differences, documents by their place in a table."""
    docs, place = np.unique(s["doc"], return_inverse=True)
    head = np.array([len(s), len(docs)], "<u4")
    return b"".join([head.tobytes(), docs.astype("<i8").tobytes(), planes(np.diff(s["h"], prepend=np.uint64(0))), s["f"].tobytes(), planes(place.astype("<u4")), planes(s["pos"]), s["flag"].tobytes()])


def _unpacked(buf: pa.Buffer) -> np.ndarray:
    b = memoryview(buf)
    n, k = np.frombuffer(b[:8], "<u4").tolist()
    docs, b = np.frombuffer(b[8 : 8 + 8 * k], "<i8"), b[8 + 8 * k :]
    out = np.zeros(n, SEED)
    out["h"] = np.cumsum(from_planes(b, "<u8", n), dtype=np.uint64)
    out["f"] = np.frombuffer(b[8 * n : 16 * n], "<u8")
    out["doc"] = docs[from_planes(b[16 * n :], "<u4", n)]
    out["pos"] = from_planes(b[20 * n :], "<i4", n)
    out["flag"] = np.frombuffer(b[24 * n : 25 * n], np.uint8)
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of one bucket: (doc, settled places, open places)."""

    def out(rows: list[tuple[int, bytes | None, bytes | None]]) -> pa.RecordBatch:
        d, s, o = zip(*rows, strict=True)
        return pa.record_batch([pa.array(d, pa.int64()), pa.array(s, pa.binary()), pa.array(o, pa.binary())], names=["doc", "settled", "open"])

    for group in grouped(batches, "bucket"):
        seeds, rows = [], []
        for doc, payload in zip(group["doc"].to_pylist(), group["payload"], strict=True):
            if doc is None:
                seeds.append(_unpacked(payload.as_buffer()))
            else:
                rows.append((doc, payload.as_py(), None))
        if seeds:
            s = np.concatenate(seeds)
            s = s[np.lexsort((s["f"], s["h"]))]
            at = runs(s["h"])
            size = np.repeat(np.diff(at), np.diff(at))
            s = s[(size > 1) | (s["flag"] > 0)]
            common = (s["flag"] & (COMMON | STAND_IN)) > 0
            shared = set(s["h"][common].tolist())
            s = s[(s["flag"] & STAND_IN) == 0]
            at = runs(s["h"], s["f"])
            n = np.diff(at)
            many = np.add.reduceat((s["flag"] & MANY).astype(np.int64), at[:-1]) > 0 if len(s) else np.zeros(0, bool)
            again = (n > 1) | many
            each = np.repeat(again, n)
            for d, p in _by_doc(s["doc"][each], s["pos"][each]):
                rows.append((d, np.unique(p).astype("<i4").tobytes(), None))
            # one occurrence of each context, of seeds that have several and at least one that occurs once
            first, again = s[at[:-1]], again
            if len(first):
                g = runs(first["h"])
                size, alone = np.diff(g), np.add.reduceat((~again).astype(np.int64), g[:-1])
                several = (size > 1) & (alone > 0)
                if shared:  # other contexts of these are elsewhere
                    several |= np.isin(first["h"][g[:-1]], np.array(list(shared), np.uint64))
                pick = np.repeat(several, size)
                o = np.zeros(int(pick.sum()), OPEN)
                o["h"], o["pos"], o["alone"] = first["h"][pick], first["pos"][pick], ~again[pick]
                for d, x in _by_doc(first["doc"][pick], o):
                    rows.append((d, None, x.tobytes()))
        for i in range(0, len(rows), 4096):
            yield out(rows[i : i + 4096])


def _fetch(kind: str, window: int, seed: int):
    """Contexts of open seeds: units to the left of each, nearest first, and from its start to the right."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = Sequences(batch, kind)
            h, doc, pos, left, right, alone = [], [], [], [], [], []
            for i, lists in enumerate(batch.column("open")):
                if not lists.is_valid:
                    continue
                o = np.concatenate([np.frombuffer(b.as_buffer(), OPEN) for b in lists.values])
                a, b = int(x.offs[i]), int(x.offs[i + 1])
                for k, p, one in zip(o["h"].view(np.int64).tolist(), o["pos"].tolist(), o["alone"].tolist(), strict=True):
                    at = a + p
                    h.append(k)
                    doc.append(int(x.doc[i]))
                    pos.append(p)
                    left.append(x.short[max(a, at - (window - seed)) : at][::-1].tobytes())
                    right.append(x.short[at : min(b, at + window)].tobytes())
                    alone.append(one)
            for i in range(0, len(h), 2048):
                e = slice(i, i + 2048)
                yield pa.record_batch([pa.array(h[e], pa.int64()), pa.array(doc[e], pa.int64()), pa.array(pos[e], pa.int32()), pa.array(left[e], pa.binary()), pa.array(right[e], pa.binary()), pa.array(alone[e], pa.bool_())], names=["h", "doc", "pos", "left", "right", "alone"])

    return fetch


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 16_384) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or more that never part a group of equal keys; input is sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            k = batch.column(key).to_numpy(zero_copy_only=False)
            last = int(runs(k)[-2])
            if last == 0 and (len(held) == 1 or held[-2].column(key)[-1].as_py() == k[0]):
                continue
            held[-1] = batch.slice(0, last)
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
            n = batch.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _solve(solver: Solver):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "h"):
            t = t.combine_chunks()
            l, r = solver(t["h"].to_numpy(), *(view(t[k].chunk(0)) for k in ("left", "right")))
            pos, doc = t["pos"].to_numpy(), t["doc"].to_numpy()
            hit = (r > 0) & t["alone"].to_numpy()
            if hit.any():
                yield _spans([doc[hit]], [(pos - l)[hit]], [(pos + r)[hit]])

    return solve


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): contexts of open seeds, counted by batch."""
    for batch in batches:
        open_ = [np.frombuffer(x.as_buffer(), OPEN)["h"] for x in batch.column("open") if x.is_valid]
        if open_:
            h, n = np.unique(np.concatenate(open_), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _windows(window: int, seed: int, unit: int):
    """(key, doc, pos, o, alone): a hash of each whole window through a seed, o units of it lying before the seed."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                cols: list[list] = [[], [], [], [], []]
                for doc, pos, left, right, alone in zip(*(batch.column(k).to_pylist() for k in ("doc", "pos", "left", "right", "alone")), strict=True):
                    l, r = (np.frombuffer(x, np.uint8).reshape(-1, unit) for x in (left, right))
                    text = np.concatenate([l[::-1], r]).ravel()
                    sums, more = BYTES.sums(text), OTHER.sums(text)
                    o = np.arange(max(0, window - len(r)), len(l) + 1)
                    begin = (len(l) - o) * unit
                    end = begin + window * unit
                    keys = BYTES.slices(sums, begin, end) ^ (OTHER.slices(more, begin, end) << np.uint64(1))
                    for c, v in zip(cols, (keys.view(np.int64), np.full(len(o), doc), np.full(len(o), pos), o, np.full(len(o), alone)), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.record_batch([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=["key", "doc", "pos", "o", "alone"])

    return windows


def _counted(opened: DataFrame, window: int, seed: int, unit: int) -> DataFrame:
    """Spans of seeds with very many contexts: windows that occur twice are found by counting, which is summed before the shuffle, so no group is gathered."""
    w = opened.transform(in_arrow, _windows(window, seed, unit), "key long, doc long, pos int, o int, alone boolean")
    occurrence = F.struct("doc", (F.col("pos") - F.col("o")).alias("at"))  # two seeds may lie in one window
    twice = w.groupBy("key").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b")).filter("a <> b").select("key")
    reach = w.filter("alone").join(twice, "key").groupBy("doc", "pos").agg(F.max("o").alias("l"), F.min("o").alias("s"))
    span = F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") - F.col("s") + window).alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _spans([b.column("doc").to_numpy()], [b.column("a").to_numpy()], [b.column("b").to_numpy()])

    return reach.select("doc", span.alias("x")).select("doc", "x.a", "x.b").transform(in_arrow, pack, "doc long, spans binary")


def _spans(doc: list, begin: list, end: list) -> pa.RecordBatch:
    rows = [(d, np.unique(np.stack([a, b], 1), axis=0).astype("<i4").tobytes()) for d, a, b in _by_doc(np.concatenate(doc), np.concatenate(begin), np.concatenate(end))]
    d, s = zip(*rows, strict=True)
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(s, pa.binary())], names=["doc", "spans"])


def covered(length: int, settled: list[bytes], spans: list[bytes], window: int, seed: int) -> np.ndarray:
    """A mark for each unit of a text that a repeated window covers."""
    edge = np.zeros(length + 1, np.int32)
    for s in settled:
        p = np.frombuffer(s, "<i4")
        np.add.at(edge, np.maximum(p - (window - seed), 0), 1)
        np.add.at(edge, np.minimum(p + window, length), -1)
    for s in spans:
        x = np.frombuffer(s, "<i4").reshape(-1, 2)
        np.add.at(edge, x[:, 0], 1)
        np.add.at(edge, x[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def find_repeats(docs: DataFrame, kind: str, window: int, seed: int, places: Places, solver: Solver, columns: list[str] | None = None) -> DataFrame:
    """(row, text, settled, spans): `columns` of `docs` (doc_id) as one struct, so that none can clash, and lists of packed places for covered()."""
    rows = text_rows(docs)
    buckets = bucket_count(docs, BUCKET)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    seeds = rows.select("rid", "text").transform(in_arrow, _emit(kind, window, seed, places, buckets), "bucket int, doc long, payload binary")
    found = seeds.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").transform(in_arrow, _match, "doc long, settled binary, open binary")
    found = stored(found)
    need = found.filter("open IS NOT NULL").groupBy(F.col("doc").alias("rid")).agg(F.collect_set("open").alias("open"))
    own = docs.select(row_key().alias("rid"), F.struct(*(columns or ["doc_id"])).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # the same columns and kind of join as at the end, so that texts are dealt out once; of rows that repeat each other one is looked at
    opened = own.join(need, "rid", "left").filter("open IS NOT NULL").dropDuplicates(["rid"]).select("rid", "row", "text", "open")
    opened = opened.transform(in_arrow, _fetch(kind, window, seed), "h long, doc long, pos int, left binary, right binary, alone boolean")
    tally = found.filter("open IS NOT NULL").select("open").transform(in_arrow, _tally, "h long, n long")
    common = cut(tally.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > COUNT).select("h"))
    counted = None
    if not common.isEmpty():
        opened = cut(opened)
        counted = _counted(opened.join(common, "h"), window, seed, SHORT if kind == "words" else 1)
        opened = opened.join(common, "h", "left_anti")
    spans = opened.repartition(n, "h").sortWithinPartitions("h", "right").transform(in_arrow, _solve(solver), "doc long, spans binary")
    spans = spans if counted is None else spans.unionByName(counted)
    both = found.filter("settled IS NOT NULL").select("doc", "settled", F.lit(None).cast("binary").alias("spans")).unionByName(spans.withColumn("settled", F.lit(None).cast("binary")))
    both = both.groupBy(F.col("doc").alias("rid")).agg(F.collect_set("settled").alias("settled"), F.collect_set("spans").alias("spans"))
    return own.join(both, "rid", "left").select("row", "text", "settled", "spans")


__all__ = ["Sequences", "covered", "find_repeats"]
