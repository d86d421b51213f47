"""Helpers that several training-data operators share.

Tasks see text as Arrow buffers and work on whole batches with numpy, so no operator
holds a Python object per word or byte.  Batches are cut into pieces of a few MB first,
which bounds the memory of a task whatever the length of the texts.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20  # text behind one bucket of an exchange
#: Rows of two numbers that are sent to every task, after they have been counted; more are joined.
SENT_ROWS = 500_000
#: Bytes of an Arrow batch on its way to a Python worker, where the session has Spark's own default.
BATCH_BYTES, _SPARKS = 4 << 20, "67108864b"

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; only in one local JVM (tests) a temporary one will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared checkpoint folder and read from there: for rows with texts, which a checkpoint would not compress."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def row_key():
    """A row's own key: repeated rows share it, rows that share only doc_id do not."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def text_rows(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) with null text as empty; other columns of `docs` are left aside."""
    return docs.select(row_key().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def bucket_count(docs: DataFrame, unit: int = BUCKET_BYTES) -> int:
    """Buckets for an exchange, in proportion to the bytes of text so that each fits in a task."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(16, -(-total // unit)))


def partitions_for(spark: SparkSession, buckets: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)


def sent(rows: DataFrame) -> DataFrame:
    """`rows`, of a few numbers each, marked for broadcast where they are counted to be SENT_ROWS or fewer; otherwise as they are, for a join by key."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow(work, schema)` in batches of at most BATCH_BYTES, which gives back, at the end of a task, the memory that its Python worker freed: workers live on between tasks, idle ones too.

    The size is a setting of the session, read when the plan runs, so it stays set; a caller's own is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == _SPARKS:
        conf.set(name, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return df.mapInArrow(run, schema)


def view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, which begin at 0."""
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"").cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of text, or of one row where that is longer."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < len(size):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Hashes of any slice of a sequence from one running sum: slice [a, b) is (S[b] - S[a]) / B^a modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.base = (int(rng.integers(1 << 61, 1 << 62)) << 3 | 5) % (1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                out = np.full(n, np.uint64(base))
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def sums(self, values: np.ndarray) -> np.ndarray:
        values = self.table[values] if values.dtype == np.uint8 else values
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


BYTES, WORDS, OTHER = Roller(11), Roller(23), Roller(37)


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of what lies between other `separators`), and where each row's words begin."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def owners(offs: np.ndarray) -> np.ndarray:
    """For each element the row that holds it."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the length at the end; keys are sorted already."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per run of equal keys in a partition sorted by key; only one group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cutat = runs(k)
        for a, b in zip(cutat[:-1], cutat[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def planes(x: np.ndarray) -> bytes:
    """Byte by byte of each value, so that bytes that are mostly zero lie together and compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(buf: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(buf[: n * size], np.uint8).reshape(size, n).T).view(kind).ravel()


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node with a link.

    Large-star and small-star by turns: each round is two groupings over the links, which
    shrink towards stars; a node's own neighbours are met as a join, never as one list.  Links are
    dealt out by their node once for a grouping and its join, so a round has three exchanges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a condition below the join would part the two readers of one exchange; inside the array it stays above
        up = F.when((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")), F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = both.join(low, "u").select(F.explode(up).alias("x")).select("x.u", "x.v").repartition("u")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = e.join(low, "u").select(F.explode(down).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("links did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
