"""Jaccard self-join of documents on word shingles, with signature trees.

A document's set holds the hashes of its distinct shingles.  Documents with equal sets form a
class and one of them stands for all.  For two sets that link, the number of shingles in only one
of them is bounded; so when the hash space is cut into more segments than that, some segments hold
the same shingles in both.  Hashes of segments are keys, and sets that link share at least as many
keys as there are segments beyond the bound; a set that meets others under fewer keys has no link.
What remains is put in blocks by keys in common.  In a block, sets are put in a signature tree
whose nodes hold OR-combined bitmaps and size ranges; two trees are walked together, and a pair of
nodes is dropped when the largest overlap it allows is too small or it is one component already.
Pairs that remain are compared in full.

A large block is cut into parts by size.  First each part is joined with itself and with one part
of its size, and those with each other, which makes a group of near copies one component.  Only where a block is more than one
component after that, sets are dealt out again by component, and pairs of parts that are not one
component already are joined in tasks of their own.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.  A text with fewer words than a shingle has
its whole word sequence as one; null texts and texts without words have an empty set and link with
nothing.  Repeated rows are in one class, and null ids come after all others.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTES, WORDS, bucket_count, chunks, connected, cut, from_planes, grouped, in_arrow, lowered, mixed, owners, planes, row_key, runs, sent, signed, stored, text_rows, view, words

SHINGLE, PERCENT = 5, 80
#: Sizes are put in classes that grow by half.
GROWTH = 1.5
#: Bytes of text behind one bucket of segment keys, keys sent at once, and sets that a task remembers as sent.
BUCKET, FOLD, REMEMBERED = 4 << 20, 250_000, 50_000
#: Sets in one part of a block, and their members.
PART, PART_MEMBERS = 1024, 500_000
LEAF, FAN = 8, 8
#: Sizes of parts: classes of the logarithm.
CLASSES = 5
#: Sets of one key in a batch from which they are sent on as they are.
GROUP = 12
SETS, STAND_IN, LARGE, NEED = 0, 1, 2, 3


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    data, byte_offs = view(batch.column("text"))
    data = lowered(data)
    starts, ends, offs = words(data, byte_offs)
    n = np.diff(offs)
    units = BYTES.slices(BYTES.sums(data), starts, ends)
    sums = WORDS.sums(units)
    last = np.repeat(offs[1:], n)
    begin = np.arange(len(units))
    whole = np.repeat(n, n) < width
    first = begin == np.repeat(offs[:-1], n)
    pick = np.flatnonzero((begin + width <= last) | (whole & first))
    end = np.where(whole[pick], last[pick], pick + width)
    h = WORDS.slices(sums, pick, end)
    row = owners(offs)[pick]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    at = runs(row, h)[:-1]
    h, row = h[at], row[at]
    return h, np.searchsorted(row, np.arange(batch.num_rows + 1))


def fingerprints(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One number for each set, from the sum over its members."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + np.uint64(0x1234567)), dtype=np.uint64)])
    a, b = total[offs[1:]] - total[offs[:-1]], other[offs[1:]] - other[offs[:-1]]
    return mixed(a + np.diff(offs).astype(np.uint64)) ^ (mixed(b) * np.uint64(0x9E3779B97F4A7C15))


def bounds(most: int, growth: float = GROWTH) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return out


def _spare(k: int) -> int:
    """Segments beyond the bound: a link shares at least as many, less those that are empty in both sets."""
    return 2 + k // 4


def _jobs(n: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(number, bound on differences, rows): one for each size class, and one for each border between classes."""
    edges, t = np.array(bounds(int(n.max(initial=1)))), percent
    cls = np.searchsorted(edges, n, "right") - 1
    jobs = []
    for c in np.unique(cls[n > 0]):
        jobs.append((2 * int(c), 2 * (int(edges[c + 1]) - 1) * (100 - t) // (100 + t), np.flatnonzero((cls == c) & (n > 0))))
    for c in range(1, len(edges)):
        e = int(edges[c])
        near = np.flatnonzero((100 * n >= t * e) & (t * n < 100 * e) & (n > 0))
        if len(near):
            jobs.append((2 * c + 1, ((e - 1) + 100 * (e - 1) // t) * (100 - t) // (100 + t), near))
    return jobs


def segment_keys(h: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, need of each row).  Sets that link share a key; a set shares at least `need` of its keys with any set that it links to.

    Between linking sets of sizes a and b at most d = (a + b)(100 - t)/(100 + t) shingles differ.
    A size class uses the bound of its largest sizes; sizes near a class border, which may link
    across it, also get keys made for the border.
    """
    keys, rows, n = [], [], np.diff(offs)
    need = np.full(len(n), 1 << 30, np.int64)
    for job, k, own in _jobs(n, percent):
        if k == 0:
            continue  # only equal sets link, and those are one class
        m = k + 1 + _spare(k)
        size = n[own]
        idx = np.repeat(offs[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x, r = h[idx], np.repeat(np.arange(len(own)), size)
        seg = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = r * m + seg  # ascending: members of a set are sorted
        at = runs(place)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(x), dtype=np.uint64)])
        part = total[at[1:]] - total[at[:-1]]
        place = place[at[:-1]]
        tag = (place % m).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(job)
        keys.append(mixed(part ^ mixed(tag)))
        rows.append(own[place // m])
        # where more segments are empty than are spared, emptiness is a key too
        full = np.bincount(place // m, minlength=len(own))
        need[own] = np.minimum(need[own], np.maximum(1, m - k - (m - full)))
        bare = np.flatnonzero(m - full >= m - k)
        for b in bare:
            seen = np.zeros(m, bool)
            seen[place[np.searchsorted(place, b * m) : np.searchsorted(place, (b + 1) * m)] % m] = True
            gap = np.flatnonzero(~seen).astype(np.uint64)
            keys.append(mixed(np.uint64(0x5EED) ^ mixed(gap * np.uint64(1 << 20) + np.uint64(job))))
            rows.append(np.full(len(gap), own[b]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    return np.concatenate(keys), np.concatenate(rows), need


def _sizes(width: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, offs = shingle_sets(batch, width)
            n = np.diff(offs)
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), pa.array(n), pa.array(signed(fingerprints(h, offs)))], names=["rid", "doc_id", "n_shingles", "fp"])

    return sizes


def _keys(width: int, percent: int, buckets: int):
    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        at = runs(key)
        large = np.diff(at) > GROUP
        member = np.repeat(large, np.diff(at))
        rows = []
        # a key of many sets is known to be large: its sets need not meet, and one stands in for them
        for kind, k, f in ((SETS, key[~member], fp[~member]), (STAND_IN, key[at[:-1]][large], fp[at[:-1]][large])):
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cutat = runs(bucket)  # keys are sorted, and so are their buckets
            rows += [(int(bucket[a]), kind, _packed(k[a:b], f[a:b])) for a, b in zip(cutat[:-1], cutat[1:], strict=True)]
        key, fp = key[member], fp[member]
        rows += [(int(key[a] % np.uint64(buckets)), LARGE, key[a : a + 8192].tobytes() + fp[a : a + 8192].tobytes()) for a in range(0, len(key), 8192)]
        for i, (_, _, sets, need) in enumerate(held):
            rows.append((i % buckets, NEED, sets.tobytes() + need.tobytes()))
        b, k, p = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, np.zeros(0, np.uint64)
        for batch in chunks(batches):
            h, offs = shingle_sets(batch, width)
            fp = fingerprints(h, offs)
            first = np.zeros(len(fp), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            pick = np.flatnonzero(first & ~np.isin(fp, seen))
            seen = fp[pick] if len(seen) > REMEMBERED else np.concatenate([seen, fp[pick]])
            size = np.diff(offs)[pick]
            idx = np.repeat(offs[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            key, row, need = segment_keys(h[idx], np.concatenate([[0], np.cumsum(size)]), percent)
            if len(key):
                held.append((key, fp[pick][row], fp[pick], need))
                n += len(key)
            if n >= FOLD:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    return keys


def _packed(key: np.ndarray, fp: np.ndarray) -> bytes:
    """Sorted keys as differences, sets by their place in a table; byte planes that are zero compress to nothing."""
    table, place = np.unique(fp, return_inverse=True)
    return b"".join([np.array([len(key), len(table)], "<u4").tobytes(), table.tobytes(), planes(np.diff(key, prepend=np.uint64(0))), planes(place.astype("<u4"))])


def _unpacked(buf: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    b = memoryview(buf)
    n, k = np.frombuffer(b[:8], "<u4").tolist()
    table, b = np.frombuffer(b[8 : 8 + 8 * k], np.int64), b[8 + 8 * k :]
    return np.cumsum(from_planes(b, "<u8", n), dtype=np.uint64), table[from_planes(b[8 * n :], "<u4", n)]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, need): sets of each key that two or more have; rows without a key say how many such keys a set needs."""

    def out(key: np.ndarray, fp: np.ndarray, need: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(fp), pa.int64())
        return pa.record_batch([none if need is not None else pa.array(signed(key)), pa.array(fp), none if need is None else pa.array(need)], names=["key", "fp", "need"])

    for group in grouped(batches, "bucket"):
        parts: dict[int, list] = {SETS: [], STAND_IN: []}
        for kind, p in zip(group["kind"].to_pylist(), group["payload"], strict=True):
            if kind in parts:
                parts[kind].append(_unpacked(p.as_buffer()))
                continue
            x = np.frombuffer(p.as_buffer(), np.uint64)
            a, b = x[: len(x) // 2], x[len(x) // 2 :].view(np.int64)
            yield out(a, b) if kind == LARGE else out(a, a.view(np.int64), b)
        if not parts[SETS]:
            continue
        key, fp = (np.concatenate(x) for x in zip(*parts[SETS], strict=True))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        at = runs(key, fp)[:-1]
        key, fp = key[at], fp[at]
        at = runs(key)
        several = np.diff(at) > 1
        if parts[STAND_IN]:
            several |= np.isin(key[at[:-1]], np.concatenate([a for a, _ in parts[STAND_IN]]))
        member = np.repeat(several, np.diff(at))
        yield out(key[member], fp[member])


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, offs = shingle_sets(batch, width)
            yield pa.record_batch([batch.column("fp"), pa.array([h[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["fp", "members"])

    return sets


class SignatureTree:
    """Sets by size class and smallest member, so that like sets share leaves; each node ORs the bitmaps below it."""

    def __init__(self, sets: list[np.ndarray], own: np.ndarray, bits: int):
        n = np.array([len(sets[i]) for i in own])
        low = np.array([sets[i][0] for i in own], np.uint64)
        own = own[np.lexsort((n, low, np.floor(np.log(n) * 8)))]
        self.own = own
        size = np.array([len(sets[i]) for i in own])
        sig = np.zeros((len(own), bits // 64), np.uint64)
        for r, i in enumerate(own):
            b = sets[i] & np.uint64(bits - 1)
            np.bitwise_or.at(sig[r], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        extra = size - np.bitwise_count(sig).sum(1, dtype=np.int64)
        self.levels = [(sig, size, size, extra)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            s, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(s), width)
            self.levels.append((np.bitwise_or.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
            width = FAN

    def children(self, level: int, i: int) -> tuple[int, int]:
        w = LEAF if level == 1 else FAN
        return i * w, min((i + 1) * w, len(self.levels[level - 1][0]))


def tree_join(a: SignatureTree, b: SignatureTree, sets: list[np.ndarray], percent: int, root: list[int]) -> Iterator[tuple[int, int]]:
    """Walk two trees at once; yields each link that joins two components (root is updated)."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    t, same = percent, a is b
    stack = [(len(a.levels) - 1, 0, 1, len(b.levels) - 1, 0, 1)]
    while stack:
        la, a0, a1, lb, b0, b1 = stack.pop()
        sa, loa, hia, exa = (x[a0:a1] for x in a.levels[la])
        sb, lob, hib, exb = (x[b0:b1] for x in b.levels[lb])
        may = (100 * hia[:, None] >= t * lob[None, :]) & (100 * hib[None, :] >= t * loa[:, None])
        need = -(-(loa[:, None] + lob[None, :]) * t // (100 + t))
        common = np.bitwise_count(sa[:, None, :] & sb[None, :, :]).sum(2, dtype=np.int64)
        may &= common + np.minimum(exa[:, None], exb[None, :]) >= need
        for i, j in zip(*np.nonzero(may), strict=True):
            x, y = a0 + int(i), b0 + int(j)
            if same and la == lb and x > y:
                continue
            if la == 0 and lb == 0:
                p, q = int(a.own[x]), int(b.own[y])
                if p == q or (u := find(p)) == (v := find(q)):
                    continue
                s, r = sets[p], sets[q]
                at = np.minimum(np.searchsorted(r, s), len(r) - 1)
                inter = int((r[at] == s).sum())
                if 100 * inter >= t * (len(s) + len(r) - inter):
                    root[max(u, v)] = min(u, v)
                    yield p, q
                continue
            ca = a.children(la, x) if la >= lb and la else (x, x + 1)
            cb = b.children(lb, y) if lb >= la and lb else (y, y + 1)
            na, nb = (la - 1 if la >= lb and la else la), (lb - 1 if lb >= la and lb else lb)
            if na == 0 and nb == 0:
                one = {find(int(k)) for k in a.own[ca[0] : ca[1]]} | {find(int(k)) for k in b.own[cb[0] : cb[1]]}
                if len(one) == 1:
                    continue
            stack.append((na, *ca, nb, *cb))


def _verify(percent: int):
    def solve(t: pa.Table) -> tuple[list[int], list[int]]:
        fp, first = t["fp"].to_numpy(), {}
        for i, x in enumerate(fp.tolist()):
            first.setdefault(x, i)
        pick = list(first.values())
        sets = [np.frombuffer(t["members"][i].as_buffer(), np.uint64) for i in pick]
        side = t["right"].to_numpy(zero_copy_only=False)[pick]
        bits = 1 << max(9, int(2 * max(map(len, sets)) - 1).bit_length())
        _, at, inverse = np.unique(t["comp"].to_numpy()[pick], return_index=True, return_inverse=True)
        root, everyone = at[inverse].tolist(), np.arange(len(sets))  # sets of one component begin as one
        parts = [everyone[~side], everyone[side]]
        trees = [SignatureTree(sets, p, bits) for p in parts if len(p)]
        pairs = list(tree_join(trees[0], trees[-1], sets, percent, root))
        return [pick[p] for p, _ in pairs], [pick[q] for _, q in pairs]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            a, b = solve(group)
            if a:
                group = group.select(["last", "least", "fp"]).combine_chunks()
                one, two = (pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in group.take(pa.array(i)).columns], names=["last", "least", "fp"]) for i in (a, b))
                yield pa.record_batch([one, two], names=["a", "b"])

    return verify


#: A class as a node of the link graph: classes are ordered by their smallest doc_id, so the root of a component has the component's.
NODE = "struct<last:boolean,least:long,fp:long>"


def _blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(fp, block): sets that may link, in blocks that no link leaves."""
    buckets = bucket_count(rows, BUCKET)
    keys = rows.select("text").transform(in_arrow, _keys(width, percent, buckets), "bucket int, kind int, payload binary")
    met = stored(keys.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").transform(in_arrow, _meetings, "key long, fp long, need long"))
    needs = met.filter("need IS NOT NULL").groupBy("fp").agg(F.min("need").alias("need"))
    left = met.filter("need IS NULL").select("key", "fp")
    # a set that meets others under fewer keys than a link shares has no link
    enough = left.groupBy("fp").agg(F.count("*").alias("c")).join(needs, "fp").filter("c >= need").select("fp")
    left = left.join(enough, "fp")
    hubs = left.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).filter("hub <> other").select("key", "hub")
    near = connected(left.join(hubs, "key").select("fp", "hub"), "fp", "hub")
    return near.select(F.col("node").alias("fp"), F.col("root").alias("block")).union(near.select(F.col("root").alias("fp"), F.col("root").alias("block")).distinct())


def _links(rows: DataFrame, seats: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links found in the tasks of `seats` (rid, fp, last, least, comp, task, right); sets are made from one text of each class."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), bucket_count(rows, 4 * BUCKET))
    texts = rows.join(sent(seats.select("rid", "fp").distinct()), "rid").select("text", "fp").transform(in_arrow, _sets(width), "fp long, members binary")
    seated = seats.drop("rid").join(texts, "fp")
    return cut(seated.repartition(n, "task").sortWithinPartitions("task").transform(in_arrow, _verify(percent), f"a {NODE}, b {NODE}"))


def _node() -> Column:
    return F.struct("last", "least", "fp")


def _parts(k: Column, size: Column) -> Column:
    """Parts that `size` sets with k members in all take."""
    return F.greatest(F.ceil(size / PART), F.ceil(k / PART_MEMBERS))


def ngram_join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, keep_rid: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links lead to, its own included); with keep_rid the row's key and its component's root too (null: the set is empty)."""
    rows = text_rows(docs)
    sized = cut(rows.transform(in_arrow, _sizes(width), "rid long, doc_id long, n_shingles long, fp long"))
    near = _blocks(rows, width, percent)
    # a class is read from one of its rows
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("least"))).alias("x")
    classes = sized.filter("n_shingles > 0").groupBy("fp").agg(F.min("rid").alias("rid"), F.min("n_shingles").alias("n"), least).select("fp", "rid", "n", "x.last", "x.least")
    members = cut(near.join(classes, "fp").withColumn("s", F.floor(F.log("n") * CLASSES).cast("int")))
    # only blocks beyond PART or PART_MEMBERS are parted: by size, and each size by hash
    sizes = members.groupBy("block", "s").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    large = sizes.groupBy("block").agg(_parts(F.sum("t"), F.sum("c")).alias("k")).filter("k > 1").select("block")
    large = cut(sizes.join(large, "block").select("block", "s", _parts(F.col("t"), F.col("c")).cast("long").alias("k")))
    seats = members.join(large, ["block", "s"], "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")))
    # the first part of each size sits with every part of that size and with the first parts of the sizes that it may link to, the others with themselves and with it
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.xxhash64("block", "s", i))
    across = F.transform(F.sequence(F.lit(0), F.lit(1 + math.floor(CLASSES * math.log(100 / percent)))), lambda r: F.xxhash64("block", F.col("s") - r, F.lit("across")))
    every = F.concat(every, across)
    tasks = F.when(F.col("k").isNull(), F.array(F.xxhash64("block"))).when(F.col("part") == 0, every).otherwise(F.array(F.xxhash64("block", "s", "part")))
    links = _links(rows, seats.select("rid", "fp", "last", "least", F.col("fp").alias("comp"), F.explode(tasks).alias("task"), F.lit(False).alias("right")), width, percent)
    joined = connected(links)
    if not large.isEmpty():
        again = _second_seats(members.join(large.select("block").distinct(), "block", "left_semi"), joined, percent)
        if not again.isEmpty():
            joined = connected(links.union(_links(rows, again, width, percent)))
    # without a link a class is a component of its own
    root = joined.select(F.col("node.fp").alias("fp"), F.col("root").alias("_root"))
    ids = classes.join(root, "fp", "left").select("fp", F.coalesce("_root", _node()).alias("_root"))
    alone = F.col("n_shingles") == 0
    return sized.join(ids, "fp", "left").select(*(["rid", F.col("_root").alias("root")] if keep_rid else []), "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("_root.least")).alias("component_id"))


def _second_seats(members: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Seats for large blocks that are several components: sets of a large component sit in parts of its own, all others by size; pairs of parts of one component are left out."""
    comp = joined.select(F.col("node.fp").alias("fp"), F.col("root.fp").alias("comp"))
    m = members.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    several = m.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("block")
    m = cut(m.join(several, "block", "left_semi"))
    own = m.groupBy("block", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("t")).filter(F.col("c") >= PART / 4)
    own = own.select("block", "comp", _parts(F.col("t"), F.col("c")).alias("k"), F.lit(True).alias("own"))
    m = m.join(own, ["block", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    # all other sets of a block are one part where they fit in one, so that parts of large components are sent to one task each
    rest = m.filter("NOT own").groupBy("block", "s").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    whole = rest.groupBy("block").agg((_parts(F.sum("t"), F.sum("c")) <= 1).alias("whole"))
    rest = rest.join(whole, "block").select("block", "s", "whole", _parts(F.col("t"), F.col("c")).alias("k2"))
    m = m.join(rest, ["block", "s"], "left")
    by_size = F.xxhash64("s", F.lit("s"), F.pmod(F.xxhash64("fp"), F.col("k2")))
    at = F.when(F.col("own"), F.xxhash64("comp", F.pmod(F.xxhash64("fp"), F.col("k")))).when(F.col("whole"), F.lit(0).cast("long")).otherwise(by_size)
    m = cut(m.withColumn("part", at).select("rid", "fp", "last", "least", "n", "block", "comp", "own", "part"))
    parts = m.groupBy("block", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.when(F.col("own"), F.col("comp"))).alias("one"))
    other = parts.select("block", F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("one").alias("one2"))
    pairs = parts.join(other, "block").filter((F.col("part") <= F.col("part2")) & (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo")))
    pairs = pairs.filter("NOT coalesce(one = one2, false)").withColumn("task", F.xxhash64("block", "part", "part2"))
    sides = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("right")), F.struct(F.col("part2").alias("part"), (F.col("part") != F.col("part2")).alias("right")))
    seats = pairs.select("block", "task", F.explode(sides).alias("x")).select("block", "task", "x.part", "x.right").distinct()
    return m.join(seats, ["block", "part"]).select("rid", "fp", "last", "least", "comp", "task", "right")


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, null ids last (of rows that repeat it, one).  Texts without words link with nothing, so all of them stay."""
    found = ngram_join(docs, width, percent, keep_rid=True)
    worded = found.filter("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    kept = worded.groupBy("root").agg(first.alias("first")).select(F.col("first.rid").alias("rid"))
    rows = worded.groupBy("rid").agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), "rid", "left")
    # rows that go, and those that repeat a row that stays; all others, and texts without words, are not moved
    odd = cut(rows.filter("kept IS NULL OR n > 1").select("rid", F.coalesce("kept", F.lit(False)).alias("kept")))
    own = docs.select(row_key().alias("rid"), F.struct(*docs.columns).alias("row"))
    out = own.join(sent(odd.select("rid")), "rid", "left_anti").select("row.*")
    again = odd.filter("kept").select("rid")
    if again.isEmpty():
        return out
    return out.unionByName(own.join(sent(again), "rid", "left_semi").dropDuplicates(["rid"]).select("row.*"))
