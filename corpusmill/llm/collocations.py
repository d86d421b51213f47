"""Mining of collocations: phrases of a few words that stand together more often than their parts would.

Texts are encoded once against the words of their own chunk and written; the words of all chunks are
counted per language, frequent ones get dense ids, and each chunk gets back the ids of its own words, so
no task holds the dictionary.  Words that are not frequent, and piece ends, break the sequence.  The
n-grams of ids that are left are packed into keys of fixed width, radix-sorted and run-length counted in
the task, dealt out by ranges of keys and counted again over the sorted ranges.

A null text has no words, a null language is `und`.  Texts of any length are counted whole: long ones are
cut where a piece ends.  Repeated rows count each time.  Ties in the order are settled by the phrase.  An
empty table, or one without frequent phrases, gives an empty result.  Only `text` and `lang` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, chunks, cut, from_planes, in_arrow, lowered, partitions_for, planes, stored, view, words

GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: N-grams that a task gathers before it sorts and counts them, and keys of a packed row at most.
GATHERED, PACKED = 1 << 21, 1 << 18
#: Keys of one range, the most ranges, and the sample that cuts them: keys of a packed row, packed rows.
RANGE, PARTS, SAMPLED_KEYS, SAMPLED_ROWS = 1 << 20, 100_000, 256, 4096
#: Rows of one window when the first rows of each group are sought.
PART = 20_000

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[list(GAPS)] = True


def _stretches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of a batch; a text longer than `most` is cut after breaks."""
    data, offs = view(batch.column("text"))
    data = lowered(data)
    if len(data) <= most or len(offs) > 2:
        yield data, offs
        return
    ends = np.flatnonzero(_BREAK[data]) + 1
    at = np.searchsorted(ends, np.arange(most, len(data), most))
    edges = np.unique(np.concatenate([[0], ends[at[at < len(ends)]], [len(data)]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield data[a:b], np.array([0, b - a])


def _own_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The text as places in its own word list, from 1 on, with 0 before every piece; the list; how often each word occurs."""
    starts, ends, first = words(data, offs, _SEPARATOR)
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint32), pa.array([], pa.string()), np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts, out=total[1:])
    flat = data[~_SEPARATOR[data]]
    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(total), pa.py_buffer(flat)]).dictionary_encode()
    own = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    piece, new = np.cumsum(_BREAK[data])[starts], np.zeros(n, bool)
    new[1:] = piece[1:] != piece[:-1]
    new[first[first < n]] = True
    codes = np.zeros(n + int(new.sum()), np.uint32)
    codes[np.arange(n) + np.cumsum(new)] = own + 1
    return codes, got.dictionary.cast(pa.large_string()).cast(pa.string()), np.bincount(own, minlength=len(got.dictionary))


_CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("n_codes", pa.int64()), ("codes", pa.binary()), ("words", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])


def _encode(most: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, most=most):
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for data, offs in _stretches(batch.filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k)), most):
                    codes, own, n = _own_codes(data, offs)
                    if len(own):
                        items = pa.StructArray.from_arrays([own, pa.array(n, pa.int64())], ["word", "n"])
                        lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), items)
                        yield pa.record_batch([pa.array([chunk]), pa.array([lang]), pa.array([int(n.sum())]), pa.array([len(codes)]), pa.array([planes(codes)], pa.binary()), lists], schema=_CHUNK)
                        chunk += 1

    return encode


def encoded_chunks(docs: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Written chunks of text: (chunk, lang, n_words, n_codes, codes, words)."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(in_arrow(rows, _encode(most), "chunk long, lang string, n_words long, n_codes long, codes binary, words array<struct<word: string, n: long>>"))


def frequent_words(encoded: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): dense ids from 1 on for the words of each language that occur `least` times or more."""
    each = encoded.select("lang", F.explode("words").alias("w")).groupBy("lang", "w.word").agg(F.sum("w.n").alias("f")).filter(F.col("f") >= least)
    each = stored(each.withColumn("at", F.monotonically_increasing_id()))
    # one row per partition of the line above: where its ids begin
    first = each.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    first = first.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + 1).alias("begin"))
    ids = each.join(F.broadcast(first), F.shiftright("at", 33) == F.col("part"))
    return ids.select((F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"), "lang", "word", "f")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 32-bit numbers: 16 bits at a time from the last ones on, each pass stable."""
    order = np.arange(len(keys), dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, column] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with their counts summed; without counts each row counts once."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    order = radix_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:, 0] != keys[:-1, 0]
    for c in range(1, keys.shape[1]):
        new[1:] |= keys[1:, c] != keys[:-1, c]
    begins = np.flatnonzero(new)
    return keys[begins], np.diff(begins, append=len(keys)) if counts is None else np.add.reduceat(counts[order], begins)


def grams(ids: np.ndarray, most: int) -> np.ndarray:
    """All runs of 2 to `most` ids without a 0 in them, as rows that 0 fills up."""
    out, alive = [], ids > 0
    for m in range(2, most + 1):
        if len(ids) < m:
            break
        alive = alive[:-1] & (ids[m - 1 :] > 0)
        at = np.flatnonzero(alive)
        rows = np.zeros((len(at), most), np.uint32)
        for k in range(m):
            rows[:, k] = ids[at + k]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, most), np.uint32)


_GRAM = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("n", pa.int64())])
_PACKED = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("sample", pa.binary())])


def _binary(keys: np.ndarray) -> pa.Array:
    """Rows as binary keys whose byte order is the order of the ids."""
    width = 4 * keys.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, width * (len(keys) + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys.astype(">u4")))])


def _packed(lang: str, part: int, keys: np.ndarray, n: np.ndarray, sample: bytes = b"") -> pa.RecordBatch:
    """Sorted keys and their counts as one row: the first ids as steps, all of it byte by byte."""
    steps = np.diff(keys[:, 0], prepend=np.uint32(0))
    data = planes(steps) + b"".join(planes(np.ascontiguousarray(keys[:, c])) for c in range(1, keys.shape[1])) + planes(n)
    return pa.record_batch([pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([len(keys)]), pa.array([data], pa.binary()), pa.array([sample], pa.binary())], schema=_PACKED)


def _unpacked(data: pa.Scalar, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    buf = memoryview(data.as_buffer())
    keys = np.stack([from_planes(buf[4 * size * c :], "<u4", size) for c in range(most)], axis=1)
    keys[:, 0] = np.cumsum(keys[:, 0], dtype=np.uint32)
    return keys, from_planes(buf[4 * size * most :], "<i8", size)


def _count_grams(most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted and counted n-grams of what a task has read, GATHERED at a time, in rows of PACKED keys with a few of them at even distances."""
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                lang, parts = held.popitem()
                rows = np.concatenate(parts)
                del parts
                keys, n = run_lengths(rows)
                del rows
                for at in range(0, len(keys), PACKED):
                    own = keys[at : at + PACKED]
                    yield _packed(lang, 0, own, n[at : at + PACKED], own[np.linspace(0, len(own) - 1, min(SAMPLED_KEYS, len(own))).astype(np.int64)].astype("<u4").tobytes())

        for batch in batches:
            for lang, n, codes, own in zip(batch.column("lang").to_pylist(), batch.column("n_codes").to_pylist(), batch.column("codes"), batch.column("ids"), strict=True):
                codes = from_planes(memoryview(codes.as_buffer()), "<u4", n)
                place, ids = (own.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                table = np.zeros(int(max(codes.max(), place.max())) + 1, np.uint32)
                table[place] = ids
                rows = grams(table[codes], most)
                if size + len(rows) > GATHERED:
                    yield from flush()
                    size = 0
                held.setdefault(lang, []).append(rows)
                size += len(rows)
        yield from flush()

    return count


def _place(keys: np.ndarray, key: np.ndarray) -> int:
    """How many of the sorted keys are below `key`: a binary search id by id."""
    a, b = 0, len(keys)
    for c in range(keys.shape[1]):
        own = keys[a:b, c]
        a, b = a + int(np.searchsorted(own, key[c], "left")), a + int(np.searchsorted(own, key[c], "right"))
    return a


def _deal(splitters: np.ndarray, most: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each packed row cut into ranges of keys."""
        for batch in batches:
            for lang, size, data in zip(batch.column("lang").to_pylist(), batch.column("size").to_pylist(), batch.column("data"), strict=True):
                keys, n = _unpacked(data, size, most)
                edges = [0, *(_place(keys, x) for x in splitters), size]
                for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if a < b:
                        yield _packed(lang, part, keys[a:b], n[a:b])

    return deal


def _merge(least: int, most: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of keys of one language at a time: its rows sorted and counted again; what a task holds is bounded by the distinct keys of a range."""
        now, held, size = None, [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            return run_lengths(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = fold()
            good = n >= least
            if good.any():
                yield pa.record_batch([pa.array([now[1]] * int(good.sum()), pa.string()), _binary(keys[good]), pa.array(n[good])], schema=_GRAM)

        for batch in batches:
            for part, lang, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "size")), batch.column("data"), strict=True):
                if now is not None and now != (part, lang):
                    yield from out()
                    held, size = [], 0
                now = (part, lang)
                held.append(_unpacked(data, n, most))
                size += n
                if size > GATHERED:
                    held = [fold()]
                    size = len(held[0][0]) // 2
        if held:
            yield from out()

    return merge


def frequent_grams(encoded: DataFrame, known: DataFrame, most: int, least: int, tasks: int) -> DataFrame:
    """(lang, key, n): n-grams of 2 to `most` words that occur `least` times or more."""
    own = encoded.select("chunk", "lang", F.posexplode("words").alias("at", "w")).select("chunk", "lang", (F.col("at") + 1).alias("place"), "w.word")
    own = own.join(known, ["lang", "word"]).select("chunk", F.struct("place", "id").alias("x")).repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list("x").alias("ids"))
    both = encoded.select("chunk", "lang", "n_codes", "codes").repartition(tasks, "chunk").join(own, "chunk").select("lang", "n_codes", "codes", "ids")
    found = stored(in_arrow(both, _count_grams(most), "lang string, part int, size long, data binary, sample binary"))
    rows, total = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(PARTS, max(tasks, total // RANGE))
    # splitters: even steps through a bounded sample of keys
    share = found.select("sample").filter(F.pmod(F.xxhash64("sample"), F.lit(rows)) < SAMPLED_ROWS) if rows > SAMPLED_ROWS else found.select("sample")
    sample = np.concatenate([np.zeros((0, most), "<u4"), *(np.frombuffer(r[0], "<u4").reshape(-1, most) for r in share.collect())])
    sample = sample[radix_order(sample)]
    at = np.linspace(0, len(sample), parts + 1)[1:-1].astype(np.int64)
    splitters = np.unique(sample[at], axis=0) if len(sample) else sample
    ranges = in_arrow(found, _deal(splitters, most), "lang string, part int, size long, data binary, sample binary").select("lang", "part", "size", "data")
    ranges = ranges.repartition(max(tasks, parts), "part", "lang").sortWithinPartitions("part", "lang")
    return in_arrow(ranges, _merge(least, most), "lang string, key binary, n long")


def _part(key: str, begin: Column | int, length: Column | int, most: int) -> Column:
    """Words `begin` (from 0) and on of a key, as a key of their own."""
    begin, length = (F.lit(x) if isinstance(x, int) else x for x in (begin, length))
    return F.rpad(F.substring(F.col(key), begin * 4 + 1, length * 4), 4 * most, F.lit(b"\0"))


def _words_in(key: str, most: int) -> Column:
    """How many ids of a key are not 0."""
    return F.expr(f"size(filter(sequence(0, {most} - 1), i -> substring({key}, 4 * i + 1, 4) <> X'00000000'))")


def first_rows(df: DataFrame, by: str, order: list[Column], k: int, salt: str) -> DataFrame:
    """The first k rows of each group, numbered by `rank`: groups are parted by a hash of `salt` first, until a group is small enough for one window."""
    n = df.count()
    while n > PART:
        parts = -(-n // PART)
        window = Window.partitionBy(by, F.pmod(F.xxhash64(salt), F.lit(parts))).orderBy(*order)
        df = cut(df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("rank"))
        n, before = df.count(), n
        if n > before * 3 // 4:  # many groups of few rows: no group is large
            break
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def collocations(docs: DataFrame, most: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language by score.

    Phrases of 2 to `most` words with a >= `least` occurrences are candidates.  Every cut into two parts
    has a score of floor(1000000 a^2 / (l r)), l and r being the occurrences of the parts; the lowest
    counts.  Candidates inside a longer one with at least `covered` percent of their occurrences go.  With
    `top` None all are returned, without rank.
    """
    encoded = encoded_chunks(docs)
    tasks = partitions_for(docs.sparkSession, bucket_count(docs, 8 << 20))
    known = stored(frequent_words(encoded, least))
    largest = known.agg(F.max("id")).first()[0] or 0
    if largest >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: raise `least`")
    single = known.select("lang", F.rpad(F.unhex(F.lpad(F.hex("id"), 8, "0")), 4 * most, F.lit(b"\0")).alias("key"), F.col("f").alias("n"))
    found = cut(frequent_grams(encoded, known, most, least, tasks))
    parts = found.select("key", "n").unionByName(single.select("key", "n"))
    each = found.select("lang", "key", F.col("n").alias("a"), _words_in("key", most).alias("m"))
    cuts = each.select("*", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.select("*", _part("key", 0, F.col("k"), most).alias("head"), _part("key", F.col("k"), F.col("m") - F.col("k"), most).alias("rest"))
    cuts = cuts.join(parts.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(parts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    exact = [F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")]
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * x.a * x.a div (x.l * x.r)")
    cuts = cuts.withColumn("x", F.struct(*(e.alias(c) for e, c in zip(exact, "alr", strict=True)))).withColumn("score", score)
    scored = cuts.groupBy("lang", "key", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "key", "m", "a", "best.score", "best.l", "best.r")
    # what lies inside longer candidates
    inner = F.expr(f"filter(flatten(transform(sequence(2, {most}), w -> transform(sequence(0, {most} - 1), b -> struct(b, w)))), x -> x.w < m AND x.b + x.w <= m)")
    inside = each.filter("m > 2").select("a", F.col("key").alias("long_key"), F.explode(inner).alias("x"))
    inside = inside.select("a", _part("long_key", F.col("x.b"), F.col("x.w"), most).alias("key")).groupBy("key").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, "key", "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {int(covered)}").drop("longer")
    kept = cut(kept)
    if top is not None:
        # the last place's score first, so that only rows that can be listed get their words
        last = first_rows(kept.select("lang", "key", "score", "a"), "lang", [F.desc("score"), F.desc("a")], top, "key")
        last = last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("bar"))
        kept = kept.join(last, "lang").filter(F.struct("score", "a") >= F.col("bar")).drop("bar")
    at = F.expr("transform(sequence(0, m - 1), i -> CAST(conv(hex(substring(key, 4 * i + 1, 4)), 16, 10) AS BIGINT))")
    spelled = kept.select("key", F.posexplode(at).alias("at", "id")).join(known.select("id", "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    out = kept.join(spelled, "key").select("lang", "key", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "score")
    if top is not None:
        out = first_rows(cut(out), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "key")
    total = encoded.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return out.join(total, "lang").select("lang", *(["rank"] if top is not None else []), "phrase", "a", "l", "r", "n", "score")
