"""WARC archives with a Merkle fixity audit.

Pages become WARC records, each a gzip member of its own, in archives of bounded size.  The
manifest says which bytes of which archive each record takes.  Records are hashed, and hashes of
ordered offset ranges are built up to one root for each archive.  Two replicas are compared root by
root; only where hashes differ does the audit go down to the children, so it reads few rows when
little is wrong, and it ends at the records whose bytes differ or are missing.

Null url and html count as empty; an empty page is a record without a body.  Repeated rows are
records of their own with ids of their own, told apart by their places in the input, and are dealt
out like all others.  An empty table gives no archives, and an audit of it finds nothing.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, ensure_checkpoint_dir

#: An archive is closed when it has so many compressed bytes, so none is longer than this and one record.  Fan of the trees.
ARCHIVE_BYTES, FAN = 4 << 20, 16
#: Bytes of html dealt to one task.
TASK_BYTES = 16 << 20
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes in one gzip member.  The last byte of a shorter member, the highest of its size, is zero, which is what the text writer puts between lines.
MEMBER = (1 << 24) - 1
MAGIC = b"\x1f\x8b\x08"

_PLACED = "archive long, seq long, offset long, length long, page_id long, url string, hash string, record binary"


def _member(raw: bytes) -> bytes:
    """`raw` as a gzip member, or as several where it is long."""
    out = []
    for a in range(0, max(1, len(raw)), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [z.compress(raw[a : a + MEMBER]), z.flush()]
    return b"".join(out)


def record(page_id: int | None, url: str, body: bytes, place: int, date: str) -> bytes:
    """One WARC record without compression."""
    digest = hashlib.sha256(body).hexdigest()
    own = uuid.UUID(bytes=hashlib.sha256(f"{page_id} {place} {url} {digest}".encode()).digest()[:16], version=4)
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}"
    return head.encode() + END + body + END


def _encode(date: str, content: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            made = [_member(record(i, u, h or b"", p, date)) for i, u, h, p in zip(batch["page_id"].to_pylist(), batch["target"].to_pylist(), batch["html"].cast(pa.binary()).to_pylist(), batch["place"].to_pylist(), strict=True)]
            sha = [hashlib.sha256(m).hexdigest() for m in made]
            yield pa.record_batch(
                [*(batch[c] for c in ("bucket", "page_id", "url", "place")), pa.array([len(m) for m in made], pa.int64()), pa.array(sha), pa.array(made if content else [b""] * len(made), pa.binary())],
                names=["bucket", "page_id", "url", "place", "length", "hash", "record"],
            )

    return encode


def _place(archive_bytes: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one bucket after another, in order: each goes to the bucket's open archive."""
        bucket, archive, seq, offset = None, 0, 0, 0
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for b, n in zip(batch["bucket"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if b != bucket:
                    bucket, archive, seq, offset = b, b << 32, 0, 0
                elif offset >= archive_bytes:
                    archive, seq, offset = archive + 1, 0, 0
                for c, v in zip(out, (archive, seq, offset), strict=True):
                    c.append(v)
                seq, offset = seq + 1, offset + n
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in out), *(batch[c] for c in ("length", "page_id", "url", "hash", "record"))], names=["archive", "seq", "offset", "length", "page_id", "url", "hash", "record"])

    return place


def records(pages: DataFrame, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, content: bool = True) -> DataFrame:
    """(archive, seq, offset, length, page_id, url, hash, record): each page as a compressed record and its place.  Without `content` record is empty, and only narrow rows are moved; the places are the same.

    Inside an archive records stand by page_id, url and place in the input.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets = max(1, -(-total // max(archive_bytes, TASK_BYTES)))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n ]", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), target.alias("target"), "html", F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("page_id", "url", "place"), F.lit(buckets)).cast("int"))
    rows = rows.mapInArrow(_encode(date, content), "bucket int, page_id long, url string, place long, length long, hash string, record binary")
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "page_id", "url", "place").mapInArrow(_place(archive_bytes), _PLACED)


def manifest(recs: DataFrame) -> DataFrame:
    """(archive, seq, offset, length, page_id, url, hash): which bytes of which archive each record takes, and their hash."""
    return recs.drop("record")


def write_archives(recs: DataFrame, path: str) -> None:
    """One file of gzip members for each archive below `path`, each written by one task."""
    rows = recs.select("archive", "seq", F.expr("CAST(substring(record, 1, length(record) - 1) AS STRING)").alias("value"))
    rows.sortWithinPartitions("archive", "seq").select("archive", "value").write.partitionBy("archive").option("lineSep", "\0").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files that write_archives made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "archive=(\\d+)", 1).cast("long").alias("archive"), "content")


def _inflated(look: memoryview, at: int) -> tuple[bytes | None, int]:
    """What the member at `at` holds and where it ends; None where it is damaged or cut off."""
    z, parts = zlib.decompressobj(31), []
    try:
        while at < len(look) and not z.eof:
            parts.append(z.decompress(look[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(look))
    except zlib.error:
        return None, at
    return (b"".join(parts), at - len(z.unused_data)) if z.eof else (None, at)


def _members(raw: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(begin, end, record) of the records in an archive; None where one cannot be read, and reading goes on at the next member that can."""
    at, held, look = 0, None, memoryview(raw)
    while at < len(raw):
        data, end = _inflated(look, at) if raw.startswith(MAGIC, at) else (None, 0)
        if data is None:
            end = raw.find(MAGIC, at + 1)
            end = len(raw) if end < 0 else end
        if held and data is not None and held[2] is not None and not data.startswith(b"WARC/1.1\r\n"):
            held = (held[0], end, held[2] + data)  # a long record goes on in the next member
        elif held and data is None and held[2] is None:
            held = (held[0], end, None)  # what looked like a member inside a damaged one
        else:
            if held:
                yield held
            held = (at, end, data)
        at = end
    if held:
        yield held


def _parsed(raw: bytes) -> tuple[str, str, bool]:
    stop = raw.find(END)
    fields = dict(x.split(": ", 1) for x in raw[: max(stop, 0)].decode(errors="replace").split("\r\n")[1:] if ": " in x)
    size = int(fields["Content-Length"]) if fields.get("Content-Length", "").isdigit() else 0
    body = raw[stop + 4 : stop + 4 + size]
    valid = len(body) == size and fields.get("WARC-Block-Digest") == "sha256:" + hashlib.sha256(body).hexdigest()
    return fields.get("WARC-Target-URI", ""), body.decode(errors="replace"), valid


def parse(files: DataFrame) -> DataFrame:
    """(archive, seq, offset, length, url, html, valid) of the records in archives, found without a manifest; after damage reading goes on at the next member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = [(a, b - a, *(("", "", False) if data is None else _parsed(data))) for a, b, data in _members(content.as_py())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.record_batch([pa.array([archive] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["archive", "seq", "offset", "length", "url", "html", "valid"])

    return files.mapInArrow(run, "archive long, seq long, offset long, length long, url string, html string, valid boolean")


def hash_records(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(archive, seq, offset, length, hash) of a replica: each record of the manifest with the hash of what begins at its offset, or null where no record begins.

    Archives are hashed where they are read; only hashes are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                rows = [(a, hashlib.sha256(raw[a:b]).hexdigest()) for a, b, _ in _members(raw)]
                at, sha = zip(*rows, strict=True) if rows else ((), ())
                yield pa.record_batch([pa.array([archive] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array(sha, pa.string())], names=["archive", "offset", "hash"])

    found = files.select("archive", "content").mapInArrow(run, "archive long, offset long, hash string")
    return ranges.select("archive", "seq", "offset", "length").join(found, ["archive", "offset"], "left").select("archive", "seq", "offset", "length", "hash")


def merkle_tree(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """(archive, level, node, begin, end, hash): level 0 holds the records, each level above the ordered ranges of `fan` nodes, up to one root."""
    level = leaves.select("archive", F.lit(0).alias("level"), F.col("seq").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), F.coalesce("hash", F.lit("")).alias("hash"))
    out, most = level, leaves.agg(F.max("seq")).first()[0]
    k, left = 0, 1 if most is None else most + 1
    while left > 1 or k == 0:
        k, left = k + 1, -(-left // fan)
        level = level.groupBy("archive", F.floor(F.col("node") / fan).alias("node")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids"))
        level = level.select("archive", F.lit(k).alias("level"), "node", "begin", "end", F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ":"), 256).alias("hash"))
        level = cut(level)  # each level is made from the one below it, not from the leaves again
        out = out.union(level)
    return out


def audit(one: DataFrame, two: DataFrame, fan: int = FAN) -> DataFrame:
    """(archive, seq, begin, end, status) of the records in which two trees differ: corrupt, missing (in two) or extra."""
    top = one.agg(F.max("level")).first()[0]
    top2 = two.agg(F.max("level")).first()[0]
    top = max(-1 if top is None else top, -1 if top2 is None else top2)
    spark, open_nodes = one.sparkSession, None
    for k in range(top, -1, -1):
        a, b = (t.filter(F.col("level") == k).select("archive", "node", F.col("begin").alias(f"begin{i}"), F.col("end").alias(f"end{i}"), F.col("hash").alias(f"hash{i}")) for i, t in ((1, one), (2, two)))
        if open_nodes is not None:
            kids = open_nodes.select("archive", F.explode(F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)).alias("node"))
            a, b = a.join(kids, ["archive", "node"], "left_semi"), b.join(kids, ["archive", "node"], "left_semi")
        open_nodes = cut(a.join(b, ["archive", "node"], "full").filter("NOT (hash1 <=> hash2)"))
        if open_nodes.isEmpty():
            break
    if open_nodes is None or top < 0:
        return spark.createDataFrame([], "archive long, seq long, begin long, end long, status string")
    gone = F.col("hash2").isNull() | (F.col("hash2") == "")
    status = F.when(F.col("hash1").isNull(), "extra").when(gone, "missing").otherwise("corrupt")
    return open_nodes.select("archive", F.col("node").alias("seq"), F.coalesce("begin1", "begin2").alias("begin"), F.coalesce("end1", "end2").alias("end"), status.alias("status"))


def archive_and_audit(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` as WARC archives, read them back and audit them against what was meant to be written.

    Per page: page_id, url, archive, seq, offset, length, record_sha256 and fixity (ok, corrupt, missing).
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    meant = cut(manifest(records(pages, archive_bytes=archive_bytes, content=False)))
    if meant.isEmpty():
        return meant.select("page_id", "url", "archive", "seq", "offset", "length", F.col("hash").alias("record_sha256"), F.lit("ok").alias("fixity"))
    write_archives(records(pages, archive_bytes=archive_bytes), path)
    replica = cut(hash_records(read_archives(spark, path), meant))
    wrong = audit(merkle_tree(meant), merkle_tree(replica)).select("archive", "seq", "status")
    out = meant.join(wrong, ["archive", "seq"], "left")
    return out.select("page_id", "url", "archive", "seq", "offset", "length", F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("fixity"))
