"""Wikitext: sections, chunks, balance, templates, compression, links.

Markup nests, so a few operators walk the text; each is a short scan inside an Arrow-batched UDF,
and everything around it (joins, grouping, order) is DataFrame work.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

HEADING = re.compile(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
PROTECTED = re.compile(r"<!--.*?-->|<nowiki>.*?</nowiki>|<pre>.*?</pre>|<ref[^>/]*>.*?</ref>", re.S | re.I)
KEPT = re.compile(r"<math[^>]*>.*?</math>|<chem>.*?</chem>|<code[^>]*>.*?</code>|<ref[^>]*/>|<ref[^>/]*>.*?</ref>|\{\{(?:cite|sfn)[^{}]*\}\}", re.S | re.I)
MARKER = re.compile(r"[⟦\[({<]{1,2} ?([A-Z]+_[0-9]+) ?[⟧\])}>]{1,2}")

SECTION = "array<struct<idx:int,title:string,level:int,content:string,n_words:int>>"


def _split(text: str | None) -> list[dict]:
    """Sections by headings outside protected spans; the lead has level 0 and no title."""
    text = text or ""
    hidden = [m.span() for m in PROTECTED.finditer(text)]
    heads = [m for m in HEADING.finditer(text) if not any(a <= m.start() < b for a, b in hidden)]
    edges = [(0, "", 0)] + [(m.end(), m[2], len(m[1])) for m in heads]
    ends = [*(m.start() for m in heads), len(text)]
    out = [(title, level, text[begin:end].strip()) for (begin, title, level), end in zip(edges, ends, strict=True)]
    return [{"idx": i, "title": t, "level": v, "content": c, "n_words": len(c.split())} for i, (t, v, c) in enumerate(out)]


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section."""

    @pandas_udf(SECTION)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(_split)

    return docs.select(*(c for c in docs.columns if c != text), F.inline(split(text)))


def chunks(secs: DataFrame, most: int = 250) -> DataFrame:
    """`secs` by paragraph with chunk: paragraphs are added to a chunk while it has at most `most` words."""
    paragraphs = F.filter(F.split("content", "\n\n+"), lambda p: F.trim(p) != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        n = F.size(F.split(F.trim(p), "\\s+"))
        new = (acc["n"] > 0) & (acc["n"] + n > most)
        c = F.when(new, acc["c"] + 1).otherwise(acc["c"])
        return F.struct(F.when(new, n).otherwise(acc["n"] + n).alias("n"), c.alias("c"), F.concat(acc["out"], F.array(c)).alias("out"))

    packed = secs.withColumn("_p", paragraphs).withColumn("_c", F.aggregate("_p", start, step)["out"])
    rows = packed.select(*secs.columns, F.posexplode(F.zip_with("_p", "_c", lambda p, c: F.struct(p.alias("paragraph"), c.alias("chunk")))).alias("pos", "x"))
    return rows.select(*secs.columns, "pos", "x.paragraph", "x.chunk")


#: Opening and closing marks whose nesting is checked.
PAIRS = {"link": ("[[", "]]"), "template": ("{{", "}}"), "table": ("{|", "|}")}


def balance(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, unclosed, stray): marks without a partner, from a running depth over the marks in order."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("stray"))

    def unmatched(kind: str, opening: str, closing: str):
        marks = F.regexp_extract_all(F.col(text), F.lit("|".join(re.escape(x) for x in (opening, closing))), F.lit(0))

        def step(acc, m):
            up, empty = m == opening, acc["depth"] == 0
            return F.struct(F.when(up, acc["depth"] + 1).when(empty, 0).otherwise(acc["depth"] - 1).alias("depth"), F.when(~up & empty, acc["stray"] + 1).otherwise(acc["stray"]).alias("stray"))

        r = F.aggregate(marks, start, step)
        return F.struct(F.lit(kind).alias("kind"), r["depth"].alias("unclosed"), r["stray"].alias("stray"))

    out = [unmatched(kind, a, b) for kind, (a, b) in PAIRS.items()]
    return docs.select("doc_id", F.inline(F.array(*out))).filter("unclosed > 0 OR stray > 0")


def compress(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with compressed and kept: markup that must not change becomes short markers, held in a map."""

    @pandas_udf("struct<compressed:string,kept:map<string,string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str, dict[str, str]]:
            kept: dict[str, str] = {}

            def put(m: re.Match) -> str:
                kept[f"KEEP_{len(kept)}"] = m[0]
                return f"⟦KEEP_{len(kept) - 1}⟧"

            return KEPT.sub(put, t or ""), kept

        return pd.DataFrame([one(t) for t in s], columns=["compressed", "kept"])

    return docs.withColumn("_x", run(text)).select(*docs.columns, "_x.compressed", "_x.kept")


def restore(docs: DataFrame, text: str = "compressed", kept: str = "kept") -> DataFrame:
    """`docs` with restored: markers become markup again, also where their brackets were changed; unknown ones stay."""

    @pandas_udf("string")
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([MARKER.sub(lambda x, k=dict(k or {}): k.get(x[1], x[0]), a or "") for a, k in zip(t, m, strict=True)])

    return docs.withColumn("restored", run(text, kept))


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, target, label) of [[target|label]] links."""
    found = F.regexp_extract_all(F.col(text), F.lit("\\[\\[[^\\[\\]]+\\]\\]"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "raw")).withColumn("raw", F.expr("substring(raw, 3, length(raw) - 4)"))
    parts = F.split("raw", "\\|", 2)
    return rows.select("doc_id", "pos", F.trim(parts[0]).alias("target"), F.trim(F.coalesce(F.get(parts, 1), parts[0])).alias("label"))


def map_links(docs: DataFrame, mapping: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text): link targets replaced by mapping (target, mapped); others stay.  Text is cut at links, mapped as rows and put together in order."""
    parts = F.split(F.col(text), "(?=\\[\\[)|(?<=\\]\\])")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    target = F.when(F.col("part").rlike("^\\[\\[[^\\[\\]]+\\]\\]$"), F.trim(F.regexp_extract("part", "^\\[\\[([^|\\]]+)", 1)))
    rows = rows.withColumn("target", target).join(mapping, "target", "left")
    label = F.regexp_extract("part", "\\|([^\\]]+)\\]\\]$", 1)
    new = F.when(F.col("mapped").isNull(), F.col("part")).when(label != "", F.concat(F.lit("[["), F.col("mapped"), F.lit("|"), label, F.lit("]]"))).otherwise(F.concat(F.lit("[["), F.col("mapped"), F.lit("]]")))
    return rows.withColumn("part", new).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("text"))


def named_references(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, name, n, first): named references and the content of their first definition."""
    found = F.regexp_extract_all(F.col(text), F.lit('<ref name="[^"]+">[^<]*</ref>'), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "raw"))
    rows = rows.select("doc_id", "pos", F.regexp_extract("raw", 'name="([^"]+)"', 1).alias("name"), F.regexp_extract("raw", ">([^<]*)<", 1).alias("content"))
    return rows.groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min_by("content", "pos").alias("first"))
