"""Page sets and page parts: members, backlinks, search, media, infoboxes, references, changed terms."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .ordered import keep_first


def members(edges: DataFrame, category: str, subcategories: bool = False) -> DataFrame:
    """(title): articles (namespace 0) or subcategories (14) of a category; edges: (category, member, ns)."""
    return edges.filter((F.col("category") == category) & (F.col("ns") == (14 if subcategories else 0))).select(F.col("member").alias("title")).distinct()


def backlinks(links: DataFrame, transclusions: DataFrame, target: str, limit: int | None = None) -> DataFrame:
    """(title, kind): pages that link to or include `target`, links first, each page once, in order of title; at most `limit` where that is asked for."""
    both = links.withColumn("p", F.lit(0)).unionByName(transclusions.withColumn("p", F.lit(1))).filter((F.col("dst") == target) & (F.col("ns") == 0))
    once = keep_first(both.select(F.col("src").alias("title"), "p"), F.col("title"), F.col("p"))
    out = once.select("title", F.when(F.col("p") == 0, "link").otherwise("transclusion").alias("kind"))
    return out if limit is None else out.orderBy("title").limit(limit)


def search(pages: DataFrame, words: list[str]) -> DataFrame:
    """Pages whose text has all the words: an index lookup by word, counted."""
    low = sorted({w.lower() for w in words})
    hits = pages.select("title", F.explode(F.array_intersect(F.array_distinct(T.words(F.lower("text"))), F.array(*map(F.lit, low)))).alias("w"))
    return hits.groupBy("title").agg(F.count("*").alias("n")).filter(F.col("n") == len(low)).select("title")


def missing_pages(source: DataFrame, langlinks: DataFrame) -> DataFrame:
    """(title): pages without a counterpart, each once."""
    return source.select("title").distinct().join(langlinks.select("title"), "title", "left_anti")


def is_disambiguation(title: Column, categories: Column, marked: Column) -> Column:
    """Marked as such, so named, or in a category that says so."""
    return F.coalesce(marked, F.lit(False)) | title.rlike("\\((?:disambiguation|disambiguasi)\\)$") | F.coalesce(F.exists(categories, lambda c: F.lower(c).rlike("disambigua")), F.lit(False))


def media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, file): files of links and infobox images, named alike."""
    linked = F.regexp_extract_all(F.col(text), F.lit("\\[\\[(?:File|Image|Berkas): *([^|\\]]+)"), F.lit(1))
    boxed = F.regexp_extract_all(F.col(text), F.lit("\\| *(?:image|logo|poster) *= *([^|\\n}]+\\.[A-Za-z]{3,4})"), F.lit(1))
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.concat(linked, boxed), T.title))).alias("file"))


def media_status(files: DataFrame, commons: DataFrame, local: DataFrame, nonfree: DataFrame) -> DataFrame:
    """(doc_id, file, status): the first place that has a file; the others are tables of (file)."""
    out, names = files, ("commons", "local", "nonfree")
    for name, t in zip(names, (commons, local, nonfree), strict=True):
        out = out.join(t.select("file", F.lit(True).alias(f"_{name}")).distinct(), "file", "left")
    status = F.lit("missing")
    for name in reversed(names):
        status = F.when(F.col(f"_{name}"), name).otherwise(status)
    return out.select("doc_id", "file", status.alias("status"))


def infobox_parameters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, box, pos, name, value) of the lines '| name = value' of infoboxes."""
    box = F.regexp_extract(F.col(text), "\\{\\{Infobox ([^|\\n}]+)", 1)
    body = F.regexp_extract(F.col(text), "(?s)\\{\\{Infobox [^|\\n}]+(.*?)\\n\\}\\}", 1)
    lines = F.regexp_extract_all(body, F.lit("(?m)^\\| *[^=|\\n]+=[^\\n]*"), F.lit(0))
    rows = docs.select("doc_id", F.trim(box).alias("box"), F.posexplode(lines).alias("pos", "line"))
    return rows.select("doc_id", "box", "pos", F.trim(F.regexp_extract("line", "^\\| *([^=]+?) *=", 1)).alias("name"), F.trim(F.regexp_extract("line", "=(.*)$", 1)).alias("value"))


def map_parameters(parameters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Parameters with new names where the mapping (box, name, new) is sure of one; all others stay as they are."""
    sure = mapping.groupBy("box", "name").agg(F.min("new").alias("new"), F.max("new").alias("m")).filter("new = m").drop("m")
    return parameters.join(sure, ["box", "name"], "left").select("doc_id", "box", "pos", F.coalesce("new", "name").alias("name"), "value", F.col("new").isNotNull().alias("mapped"))


def changed_terms(pairs: DataFrame, most: int = 6, around: int = 6) -> DataFrame:
    """(pair_id, source_term, target_term, context, confidence): word runs that a revision replaced, of at most `most` words each."""

    @pandas_udf("array<struct<source_term:string,target_term:string,context:string,confidence:double>>")
    def edits(before: pd.Series, after: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> list[dict]:
            x, y = (a or "").split(), (b or "").split()
            found = []
            for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                if tag == "replace" and j - i <= most and m - k <= most:
                    found.append({"source_term": " ".join(x[i:j]), "target_term": " ".join(y[k:m]), "context": " ".join(y[max(0, k - around) : m + around]), "confidence": 0.8 if j - i == m - k else 0.7})
            return found

        return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])

    return pairs.select("pair_id", F.inline(edits("before", "after")))


def orphan_references(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, name): references that are used by name and defined nowhere in the text."""
    used = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit('<ref name="([^"]+)" */>'), F.lit(1))).alias("name")).distinct()
    made = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit('<ref name="([^"]+)">'), F.lit(1))).alias("name")).distinct()
    return used.join(made, ["doc_id", "name"], "left_anti")


def appendix_order(sections: DataFrame, order: list[str]) -> DataFrame:
    """Sections with new_idx: those named in `order` come last, in that order; all others keep their places."""
    from pyspark.sql import Window

    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("title")), F.lit(0))
    return sections.withColumn("new_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "idx")) - 1)
