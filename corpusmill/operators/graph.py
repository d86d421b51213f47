"""Dependency graphs: closure, order, blocking."""

from __future__ import annotations

import heapq
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; only in one local JVM (tests) a temporary one will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Each round reads the last one from the shared checkpoint folder, so plans and lineage stay short."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def closure(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(node, level): nodes within `depth` links of the roots, with the smallest number of links.  edges: (src, dst); roots: (node)."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    seen = front = cut(roots.select("node").distinct().withColumn("level", F.lit(0)))
    for k in range(1, depth + 1):
        front = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(front.join(seen, "node", "left_anti").withColumn("level", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def revisits(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(node, n): nodes of the closure that more than one link of it leads to; a diamond is a revisit, not a cycle."""
    c = closure(edges, roots, depth)
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    return e.join(c.filter(F.col("level") < depth).select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter("n > 1")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): what a node depends on has a smaller level; level -1 marks nodes in or behind a cycle.  edges: src needs dst.

    Peels free nodes until none is left, so a chain takes as many rounds as it is long.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    left = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    out, k = None, 0
    while True:
        free = cut(left.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        done = free.withColumn("level", F.lit(k))
        out = done if out is None else cut(out.union(done)) if k % 20 == 19 else out.union(done)
        left = cut(left.join(free, "node", "left_anti"))
        e = cut(e.join(free.select(F.col("node").alias("dst")), "dst", "left_anti"))
        k += 1
    rest = left.withColumn("level", F.lit(-1))
    return rest if out is None else out.union(rest)


def _settled(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())


def _between(edges: DataFrame) -> DataFrame:
    """Links whose ends both have links on either side; the others are on no cycle."""
    left, n = edges, None
    while n != (now := left.count()):
        n = now
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return left


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): members of each true cycle, named by its smallest member; nodes that reach each other both ways share one.

    Diamonds and nodes behind a cycle are not members.  A node linked to itself is a cycle of one, null
    ends are left out, repeated links count once, an empty table gives none.  edges: (src, dst).

    Each node takes the smallest name that leads to it; a node that keeps its own name is the smallest
    of its cycle, whose members are those of that name that lead back to it.  All such cycles are found
    at once, and links that no further cycle can use go.  Rounds follow the longest way within cycles and
    what ties them, chains at their ends included; every round is a join and a grouping by key.
    """
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    found = cut(e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")))
    e = cut(e.filter("src <> dst"))
    while not (e := _between(e)).isEmpty():
        names, last = e.select(F.col("src").alias("node")).distinct().withColumn("name", F.col("node")), None
        while last != (now := _settled(names)):
            last = now
            sent = e.join(names, e["src"] == names["node"]).select(F.col("dst").alias("node"), "name")
            names = cut(names.union(sent).groupBy("node").agg(F.min("name").alias("name")))
        one, two = (names.select(F.col("node").alias(c), F.col("name").alias(n)) for c, n in (("src", "name"), ("dst", "_name")))
        e = cut(e.join(one, "src").join(two, "dst").filter("name = _name").select("src", "dst", "name"))
        seen = front = cut(names.filter("node = name"))
        while not front.isEmpty():
            back = e.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "name").distinct()
            front = cut(back.join(seen, "node", "left_anti"))
            seen = cut(seen.union(front))
        several = seen.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
        found = cut(found.union(seen.join(several, "name").select("node", F.col("name").alias("cycle"))))
        e = e.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return found.groupBy("node").agg(F.min("cycle").alias("cycle"))


#: Nodes of one transaction, which are published one at a time.
ONE_AT_A_TIME = 100_000
#: Rows of one batch of places.
PLACES = 1 << 16


def _ranked(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, rank) of distinct names, from 0 in their order, and how many there are; only the sizes of partitions reach the driver."""
    at = F.monotonically_increasing_id()
    rows = cut(names.orderBy("name").select("name", F.shiftright(at, 33).alias("_p"), at.bitwiseAND((1 << 33) - 1).alias("_i")))
    sizes = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect())
    begins, n = [], 0
    for p, size in sizes:
        begins.append((p, n))
        n += size
    begins = names.sparkSession.createDataFrame(begins, "_p long, _begin long")
    return rows.join(F.broadcast(begins), "_p").select("name", (F.col("_begin") + F.col("_i")).alias("rank")), n


def _one_by_one(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of ranks below `n` from links (src needs dst) between them: numbers only, four bytes for each end of a link, and the free ranks as a heap."""
        parts = [[np.asarray(batch.column(i)).astype(np.int32) for i in (0, 1)] for batch in batches if batch.num_rows]
        src, dst = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i in (0, 1))
        del parts
        needs = np.bincount(src, minlength=n).astype(np.int32)
        begins = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(dst, minlength=n), out=begins[1:])
        users = src[np.argsort(dst, kind="stable")]
        del src, dst
        left, starts, out = memoryview(needs), memoryview(begins), np.empty(n, np.int32)
        free, k = np.flatnonzero(needs == 0).tolist(), 0
        while free:
            r = heapq.heappop(free)
            out[k], k = r, k + 1
            for u in users[starts[r] : starts[r + 1]].tolist():
                left[u] -= 1
                if not left[u]:
                    heapq.heappush(free, u)
        # what is left waits for a cycle and keeps the order of names
        out[k:] = np.flatnonzero(needs > 0)
        for a in range(0, n, PLACES):
            ranks = out[a : a + PLACES]
            yield pa.record_batch([pa.array(np.arange(a, a + len(ranks), dtype=np.int32)), pa.array(ranks.astype(np.int64))], names=["place", "rank"])

    return run


def ordered_names(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(place, node): the smallest free name first, one name at a time; what is left of cycles comes last, sorted.  edges: src needs dst.

    Names are sorted and numbered by Spark, and links and places are joined with them.  The order itself is a
    chain of single choices, so one task makes it, from the numbers alone: about 30 bytes for each link and
    name, and 36 for a name that is free.  More than `most` links are refused where a caller gives that.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    if most is not None and e.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} links: use levels()")
    names, n = _ranked(e.select(F.col("src").alias("name")).union(e.select("dst")).distinct())
    one, two = (names.select(F.col("name").alias(c), F.col("rank").alias(f"_{c}")) for c in ("src", "dst"))
    links = e.join(one, "src").join(two, "dst").select("_src", "_dst")
    places = links.repartition(1).mapInArrow(_one_by_one(n), "place int, rank long")
    return places.join(names, "rank").select("place", F.col("name").alias("node"))


def template_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, kind) of page texts (title, text): templates, invoked modules, and modules that a module loads."""
    found = F.array(
        F.struct(F.lit("template").alias("kind"), F.lit("Template:").alias("space"), F.regexp_extract_all("text", F.lit("(?<!\\{)\\{\\{(?!\\{) *([^{}|#:<\\n]+?) *(?=[|}\\n])"), F.lit(1)).alias("names")),
        F.struct(F.lit("invoke").alias("kind"), F.lit("Module:").alias("space"), F.regexp_extract_all("text", F.lit("\\{\\{ *#invoke: *([^|}\\n]+?) *\\|"), F.lit(1)).alias("names")),
        F.struct(F.lit("require").alias("kind"), F.lit("Module:").alias("space"), F.regexp_extract_all("text", F.lit("(?:require|mw\\.loadData) *\\(? *['\"]Module:([^'\"]+)['\"]"), F.lit(1)).alias("names")),
    )
    rows = pages.select(F.col("title").alias("src"), F.inline(found)).select("src", "kind", "space", F.explode(F.array_distinct("names")).alias("name"))
    out = rows.select("src", F.concat("space", T.title(F.regexp_replace("name", "^(?:Template|Templat):", ""))).alias("dst"), "kind")
    return out.filter("src <> dst").distinct()


def category_members(edges: DataFrame, root: str, limit: int) -> DataFrame:
    """(title, level): articles below a category, nearest levels first, then by title, at most `limit`; edges: (category, member, ns)."""
    spark = edges.sparkSession
    kids = edges.filter("ns = 14").select(F.col("category").alias("src"), F.col("member").alias("dst"))
    tree = closure(kids, spark.createDataFrame([(root,)], "node string"), depth=50)
    pages = edges.filter("ns = 0").join(tree.withColumnRenamed("node", "category"), "category").groupBy(F.col("member").alias("title")).agg(F.min("level").alias("level"))
    return pages.orderBy("level", "title").limit(limit)


def refuse_flattening(depth: int) -> None:
    """Members are taken from one category at a time: a recursive listing mixes subjects."""
    if depth > 1:
        raise ValueError("members of subcategories are not members: list one category at a time")


def transaction(nodes: DataFrame, publish: Callable[[str], bool], journal: DataFrame | None = None, reused: DataFrame | None = None, most: int = ONE_AT_A_TIME) -> DataFrame:
    """(place, node, status): nodes (place, node) published one after another, stopping at the first failure; those that the journal (node, status) or `reused` (node) has are skipped.

    Publishing is a call per node in order, so it runs on the driver, for the nodes of one deployment.
    """
    spark = nodes.sparkSession
    rows = nodes.select("place", "node")
    done = journal.filter(F.col("status").isin("published", "reused")).select("node", F.lit("skipped").alias("known")) if journal is not None else spark.createDataFrame([], "node string, known string")
    if reused is not None:
        done = done.union(reused.select("node", F.lit("reused"))).groupBy("node").agg(F.max("known").alias("known"))
    plan = rows.join(done, "node", "left").orderBy("place").limit(most + 1).collect()
    if len(plan) > most:
        raise ValueError(f"more than {most} nodes in one transaction")
    out, stopped = [], False
    for r in plan:
        if r["known"] or stopped:
            out.append((r["place"], r["node"], r["known"] or "planned"))
            continue
        try:
            ok = bool(publish(r["node"]))
        except Exception:  # a failed call is a failed node: the run stops there
            ok = False
        stopped = not ok
        out.append((r["place"], r["node"], "published" if ok else "failed"))
    return spark.createDataFrame(out, "place int, node string, status string")


def deployment(edges: DataFrame, available: DataFrame, missing: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """(node, status): deployed, or blocked where a node or anything that it needs, near or far, is missing; what the journal (node, status) has as drafted counts as there."""
    e = edges.select("src", "dst").distinct()
    if journal is not None:
        missing = missing.join(journal.filter("status = 'drafted'").select("node"), "node", "left_anti")
    blocked = front = cut(missing.select("node").distinct())
    while not front.isEmpty():
        front = e.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = cut(front.join(blocked, "node", "left_anti"))
        blocked = cut(blocked.union(front))
    nodes = available.select("node").union(e.select("src")).union(e.select("dst")).union(missing.select("node")).distinct()
    return nodes.join(blocked.withColumn("b", F.lit(True)), "node", "left").select("node", F.when(F.col("b"), "blocked").otherwise("deployed").alias("status"))
