"""Lint rules, scores, gates and source-draft audits."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as DT
from pyspark.sql.functions import pandas_udf

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str


#: Penalty of one violation by severity.
PENALTY = {"high": 12, "medium": 6, "low": 3}

#: Language-neutral rules.
RULES = [
    Rule("space_before_mark", " [,;:.!?]", "low"),
    Rule("repeated_mark", "[!?]{2,}|,{2,}", "medium"),
    Rule("hyphen_range", "[0-9]+-[0-9]+", "low"),
    Rule("shouting", "\\p{Lu}{6,}", "medium"),
    Rule("symbol_run", "[#$%&*]{3,}", "high"),
    Rule("licence_line", "Licensed under|All rights reserved|Copyright", "high"),
    Rule("mail_address", "[A-Za-z0-9._]+@[A-Za-z0-9.]+\\.[a-z]{2,}", "high"),
    Rule("double_space", "  +", "low"),
]


def violations(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rule, severity, n): rules that a text breaks; one pass over the text, no join."""
    found = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), T.n_matches("text", r.pattern).alias("n")) for r in rules))
    return docs.select("doc_id", F.inline(found)).filter("n > 0")


def clamped(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty))


def lint_score(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_violations, score, verdict): 100 less the penalties, held to 0..100; computed in the scan without a shuffle.  A null text has no violations."""
    text = F.coalesce("text", F.lit(""))
    counts = [T.n_matches(text, r.pattern) * PENALTY[r.severity] for r in rules]
    total = sum((T.n_matches(text, r.pattern) for r in rules), F.lit(0))
    out = docs.select("doc_id", total.alias("n_violations"), clamped(sum(counts, F.lit(0))).alias("score"))
    verdict = F.when(F.col("score") >= 90, "clean").when(F.col("score") >= 70, "minor").when(F.col("score") >= 40, "review").otherwise("rewrite")
    return out.withColumn("verdict", verdict)


def grade(score: Column) -> Column:
    return F.when(score >= 95, "A++").when(score >= 90, "A+").when(score >= 85, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("F")


def qa_grade(docs: DataFrame) -> DataFrame:
    """Three layers (draft, language, technique), weighted 0.25, 0.45 and 0.30; a critical finding holds the total at 65.  A null text counts as empty."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    w, s = F.size(T.words("text")), T.n_matches("text", "[.!?]+")
    rows = docs.select("doc_id", w.alias("w"), s.alias("s"), T.n_matches("text", "[#$%&*]{3,}").alias("sym"), T.n_matches("text", "[!?]{2,}").alias("rep"), T.n_matches("text", "@[A-Za-z0-9.]+\\.[a-z]{2,}").alias("mail"))
    draft = clamped(F.when(F.col("w") < 50, 40).otherwise(0) + F.when(F.col("s") * 60 < F.col("w"), 20).otherwise(0))
    language = clamped(F.least(F.lit(60), F.col("sym") * 5) + F.least(F.lit(30), F.col("rep") * 2))
    technique = clamped(F.least(F.lit(50), F.col("mail") * 25))
    rows = rows.select("doc_id", draft.alias("draft"), language.alias("language"), technique.alias("technique"), (F.col("mail") > 0).alias("critical"))
    total = F.floor((F.col("draft") * 25 + F.col("language") * 45 + F.col("technique") * 30) / 100).cast("int")
    rows = rows.withColumn("total", F.when(F.col("critical"), F.least(F.lit(65), total)).otherwise(total))
    return rows.select("*", grade(F.col("total")).alias("grade"), ((F.col("total") >= 80) & ~F.col("critical")).alias("approved"))


#: Ids in one range of an order: the most rows that one window sorts.
RANGE = 1_000_000


def predecessors(docs: DataFrame, by: str = "source", key: str = "doc_id") -> DataFrame:
    """(source_id, draft_id): each id with the one before it under the same `by`.

    Only ids move.  The order is cut into ranges of ids, so that no window holds a whole group, and
    each range begins after the last id of the ranges before it.
    """
    ids = docs.select(by, key).withColumn("_range", F.floor(F.col(key) / RANGE))
    inside = ids.withColumn("_before", F.lag(key).over(Window.partitionBy(by, "_range").orderBy(key)))
    ends = ids.groupBy(by, "_range").agg(F.max(key).alias("_end"))
    carried = ends.select(by, "_range", F.lag("_end").over(Window.partitionBy(by).orderBy("_range")).alias("_carried"))  # one row per range
    out = inside.join(carried, [by, "_range"]).select(F.coalesce("_before", "_carried").alias("source_id"), F.col(key).alias("draft_id"))
    return out.filter("source_id IS NOT NULL")


def pairs_in_order(docs: DataFrame, by: str = "source") -> DataFrame:
    """(source_id, draft_id, source_text, draft_text): each document as the draft of the one before it under the same `by`.  Ids are put in order first, and texts are joined to them."""
    texts = docs.select("doc_id", "text")
    out = predecessors(docs, by).join(texts.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source_text")), "source_id")
    return out.join(texts.select(F.col("doc_id").alias("draft_id"), F.col("text").alias("draft_text")), "draft_id").select("source_id", "draft_id", "source_text", "draft_text")


@pandas_udf(DT.ArrayType(DT.StructType([DT.StructField("value", DT.StringType()), DT.StructField("missing", DT.LongType())])))
def bag_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Values of the first array that the second has fewer of, and how many fewer."""
    return pd.Series([[{"value": v, "missing": n} for v, n in (Counter(x) - Counter(y)).items()] for x, y in zip(a, b, strict=True)])


@pandas_udf(DT.LongType())
def bag_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Values that two arrays have in common, as bags."""
    return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)])


def missing_numbers(pairs: DataFrame, pattern: str = T.NUMBER) -> DataFrame:
    """(source_id, draft_id, number, missing): each number of the source uses up one equal number of the draft; compared in the row of the pair."""
    found = bag_difference(T.matches("source_text", pattern), T.matches("draft_text", pattern))
    return pairs.filter(F.col("source_text").rlike(pattern)).select("source_id", "draft_id", F.inline(found)).select("source_id", "draft_id", F.col("value").alias("number"), "missing")


def lexical_retention(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """(source_id, draft_id, n_source, n_kept, passed): words of the source found in the draft, as bags; sources without words are left out."""
    rows = pairs.select("source_id", "draft_id", T.words(F.lower("source_text")).alias("a"), T.words(F.lower("draft_text")).alias("b")).filter("size(a) > 0")
    out = rows.select("source_id", "draft_id", F.size("a").cast("long").alias("n_source"), bag_overlap("a", "b").alias("n_kept"))
    return out.withColumn("passed", F.col("n_kept") >= F.col("n_source") * F.lit(least))


def aligned_sentences(pairs: DataFrame) -> DataFrame:
    """(source_id, draft_id, i, j): sentence i of the source with sentence round(i * m / n) of the draft, halves to even."""
    rows = pairs.select("source_id", "draft_id", F.size(T.sentences("source_text")).alias("n"), F.size(T.sentences("draft_text")).alias("m")).filter("n > 0 AND m > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    j = F.least(F.bround(F.col("i") * F.col("m") / F.col("n")).cast("int"), F.col("m") - 1)
    return rows.select("source_id", "draft_id", "i", j.alias("j"))


def section_gate(pairs: DataFrame) -> DataFrame:
    """(source_id, draft_id, reason): why a draft is refused: empty, short (under 15 % of the words) or numbers (4 or more of three digits lost)."""
    a, b = T.matches("source_text", "[0-9]{3,}"), T.matches("draft_text", "[0-9]{3,}")
    rows = pairs.select("source_id", "draft_id", F.size(T.words("source_text")).alias("a"), F.size(T.words("draft_text")).alias("b"), (F.size(a) - bag_overlap(a, b)).alias("lost"))
    reason = F.when(F.col("b") == 0, "empty").when(F.col("b") * 100 < F.col("a") * 15, "short").when(F.col("lost") >= 4, "numbers").otherwise("ok")
    return rows.select("source_id", "draft_id", reason.alias("reason"))


def entity_grounding(pairs: DataFrame) -> DataFrame:
    """(source_id, draft_id, dropped, phantom): capitalised names of one side that the other lacks."""
    a, b = F.array_distinct(T.matches("source_text", T.PROPER)), F.array_distinct(T.matches("draft_text", T.PROPER))
    return pairs.select("source_id", "draft_id", F.size(F.array_except(a, b)).alias("dropped"), F.size(F.array_except(b, a)).alias("phantom"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_characters, n_lines, n_ends, n_distinct); a null text counts as empty, which is one line."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    return docs.select(
        "doc_id", F.size(T.words("text")).alias("n_words"), F.length("text").alias("n_characters"), F.size(lines).alias("n_lines"),
        T.n_matches("text", "[.!?]+").alias("n_ends"), F.size(F.array_distinct(T.words(F.lower("text")))).alias("n_distinct"),
    )


def complexity_tier(docs: DataFrame) -> DataFrame:
    """(doc_id, tier): an ordered cascade over size, sentence length and numbers."""
    w, s, d = F.size(T.words("text")), F.greatest(F.lit(1), T.n_matches("text", "[.!?]+")), T.n_matches("text", T.NUMBER)
    rows = docs.select("doc_id", w.alias("w"), s.alias("s"), d.alias("d"))
    tier = F.when(F.col("w") < 60, "low").when(F.col("d") >= 10, "high").when(F.col("w") > 25 * F.col("s"), "high").when(F.col("w") > 400, "medium").otherwise("low")
    return rows.select("doc_id", tier.alias("tier"))
