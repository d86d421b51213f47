"""Lookup chains, existence tests, glossaries and set comparisons."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .graph import cut

#: Orders in which sources of a term are asked.
TERM_ORDER = ("custom", "topic_consensus", "consensus", "topic", "base", "idiom", "cache", "remote")
SECTION_ORDER = ("consensus", "topic_consensus", "custom", "topic", "idiom", "ethnonym", "office", "base", "cache", "remote")


#: Entries of a glossary or a list that are tested without a join.
IN_ROW = 64


def priority(source: Column, order: tuple[str, ...]) -> Column:
    """The place of a source in an order; unknown sources come last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), source), F.lit(0)).cast("int") + F.when(source.isin(*order), 0).otherwise(len(order) + 1)


def first_match(terms: DataFrame, glossary: DataFrame, order: tuple[str, ...] = TERM_ORDER) -> DataFrame:
    """Each term with its best translation: sources by priority, then target; aggregated, so no term is one group of rows."""
    ranked = glossary.withColumn("p", priority(F.col("source"), order)).groupBy("term").agg(F.min(F.struct("p", "target", "source")).alias("best"))
    return terms.join(ranked, "term", "left").select("term", F.col("best.target").alias("target"), F.col("best.source").alias("origin"))


def unambiguous(glossary: DataFrame, term: str, target: str) -> DataFrame:
    """Terms that have one target only."""
    return glossary.groupBy(term).agg(F.min(target).alias(target), F.max(target).alias("_m")).filter(F.col(target).eqNullSafe(F.col("_m"))).drop("_m")


def fallback(base: DataFrame, steps: list[tuple[str, DataFrame, str]], key: str) -> DataFrame:
    """Left joins in order; `resolved` is the first hit and `origin` its step.  steps: (name, table with key, value column)."""
    out, values = base, []
    for name, t, value in steps:
        out = out.join(t.select(key, F.col(value).alias(f"_{name}")), key, "left")
        values.append((name, F.col(f"_{name}")))
    origin = F.lit("unresolved")
    for name, v in reversed(values):
        origin = F.when(v.isNotNull(), name).otherwise(origin)
    return out.select(*base.columns, F.coalesce(*(v for _, v in values)).alias("resolved"), origin.alias("origin"))


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def present(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_semi")


def set_diff(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: members in both, missing from b and extra in b."""
    x = a.select(group, member).distinct().withColumn("_a", F.lit(1))
    y = b.select(group, member).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, [group, member], "full")
    return both.groupBy(group).agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("existing"), F.count(F.when(F.col("_b").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_a").isNull(), 1)).alias("extra"))


def candidate_terms(docs: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, term, n, rank): the top capitalised phrases of each text by words, length, then alphabet (ties are settled, so the result is stable)."""
    terms = docs.select("doc_id", F.explode(T.matches("text", T.PROPER)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.size(F.split("term", " "))), F.desc(F.length("term")), "term")
    return terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def longest_only(terms: DataFrame) -> DataFrame:
    """(doc_id, term) without terms that are part of a longer one of the same text; terms: (doc_id, term), distinct.

    A phrase inside another shares its first word with some word of it, so the comparison is an
    equi-join on (doc_id, word).
    """
    words = terms.select("doc_id", F.col("term").alias("longer"), F.explode(F.array_distinct(F.split("term", " "))).alias("head"))
    own = terms.withColumn("head", F.split("term", " ")[0])
    inside = own.join(words, ["doc_id", "head"]).filter("term <> longer AND contains(concat(' ', longer, ' '), concat(' ', term, ' '))")
    return terms.join(inside.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")


def phrase_mentions(docs: DataFrame, phrases: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, phrase, n): occurrences of phrases of up to `most` words, as an equi-join on word n-grams instead of a contains join.

    The texts are read once.  A list of IN_ROW phrases or fewer is tested in the row, so that only
    hits leave it; a longer one is joined.
    """
    w = docs.select("doc_id", T.words(F.lower("text")).alias("w"))

    def grams(k: int) -> Column:
        at = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("w", i, k), " "))

    every = F.concat(F.col("w"), *(grams(k) for k in range(2, most + 1)))
    small = [r[0] for r in phrases.select("phrase").distinct().limit(IN_ROW + 1).collect()]
    if len(small) <= IN_ROW:
        found = w.select("doc_id", F.explode(F.filter(every, lambda g: g.isin(*small))).alias("phrase"))
        return found.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))
    found = w.select("doc_id", F.explode(every).alias("phrase"))
    return found.join(phrases.select("phrase").distinct(), "phrase").groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def glossary_consistency(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(source_id, draft_id, term, target): terms of the source whose target the draft lacks; glossary: (term, target), single words.

    A glossary of IN_ROW entries or fewer is tested in the row of the pair; a longer one is joined on the words.
    """
    small = glossary.select("term", "target").distinct().limit(IN_ROW + 1).collect()
    if len(small) <= IN_ROW:
        a, b = (F.array_distinct(T.words(F.lower(c))) for c in ("source_text", "draft_text"))
        entries = F.array(*(F.struct(F.lit(r["term"]).alias("term"), F.lit(r["target"]).alias("target")) for r in small)).cast("array<struct<term:string,target:string>>")
        rows = pairs.select("source_id", "draft_id", a.alias("a"), b.alias("b"))
        return rows.select("source_id", "draft_id", F.inline(F.filter(entries, lambda g: F.array_contains(F.col("a"), g["term"]) & ~F.array_contains(F.col("b"), g["target"]))))
    src = pairs.select("source_id", "draft_id", F.explode(F.array_distinct(T.words(F.lower("source_text")))).alias("term")).join(glossary, "term")
    dst = pairs.select("source_id", "draft_id", F.explode(F.array_distinct(T.words(F.lower("draft_text")))).alias("target"))
    return src.join(dst, ["source_id", "draft_id", "target"], "left_anti").select("source_id", "draft_id", "term", "target")


# fixed values: names that translate each other
EXONYMS = [
    ("russian empire", "kekaisaran rusia"),
    ("saint petersburg", "sankt-peterburg"),
    ("st. petersburg", "sankt-peterburg"),
    ("st petersburg", "sankt-peterburg"),
    ("united states", "amerika serikat"),
    ("united kingdom", "britania raya"),
    ("soviet union", "uni soviet"),
    ("academy awards", "academy awards"),
    ("academy award", "piala oscar"),
    ("world war i", "perang dunia i"),
    ("world war ii", "perang dunia ii"),
    ("alexander i of russia", "aleksandr i dari rusia"),
    ("alexander ii of russia", "aleksandr ii dari rusia"),
    ("alexander iii of russia", "aleksandr iii dari rusia"),
    ("sexually transmitted infection", "penyakit menular seksual"),
    ("sexually transmitted infection", "infeksi menular seksual"),
    ("blue-collar worker", "buruh"),
    ("blue-collar worker", "pekerja"),
    ("blue-collar", "buruh pabrik"),
    ("sunday school", "sekolah minggu"),
    ("fairy tales", "dongeng anak-anak"),
    ("fairy tales", "dongeng"),
    ("children's aid society", "lembaga bantuan anak"),
    ("society for cheap lodging", "perhimpunan pemondokan murah"),
    ("russian women's publishing cooperative", "koperasi penerbitan perempuan rusia"),
    ("women's mutual philanthropic society", "perhimpunan amal bersama perempuan rusia"),
    ("zhenskoe delo", "zhenskoye delo"),
    ("zhenskoe delo", "urusan perempuan"),
]
#: Letters of one class of sounds, written as one of them.  A default; a caller brings others.
SOUNDS = str.maketrans("cqxzfvyw", "kkssppiu")
#: The last vowels of a word, with what follows, are its ending; what is left is its stem if it has this many letters.
ENDING, LEAST_STEM = re.compile(r"[aeiou]+[^aeiou]*$"), 3


def folded(name: str) -> str:
    return name.strip().casefold()


def stem(word: str, sounds: dict[int, str] = SOUNDS) -> str:
    """A loanword by its sounds: silent h and doubled letters dropped, one letter for each class, the ending cut off."""
    w = word.lower()
    w = (w[:1] + w[1:].replace("h", "")).translate(sounds)
    w = "".join(x for x, before in zip(w, " " + w, strict=False) if x != before)
    short = ENDING.sub("", w)
    return short if len(short) >= LEAST_STEM else w


@lru_cache(1 << 16)
def _least_match(total: int, least: float) -> int:
    """Letters that must match for two names of `total` letters to reach the ratio."""
    m = max(0, int(least * total / 2) - 1)
    while total and 2.0 * m / total < least:
        m += 1
    return m


@lru_cache(1 << 12)
def _partners(n: int, least: float) -> list[tuple[int, int, int]]:
    """(length, letters that must match, segments) for each length that can reach the ratio with n letters.

    Letters without a match number at most n + length - 2 * match, and each spoils one segment at most; with one segment more, one is whole in both names.
    """
    out = []
    for other in range(int(n * (2 - least) / least) + 2):
        m = _least_match(n + other, least)
        if m <= min(n, other):
            out.append((other, m, n + other - 2 * m + 1))
    return out


def _segments(least: float, whole: bool):
    """(name, la, lb, i, s): segments of the names of b (whole), or the slices of the names of a that can equal them."""

    def keys(name: str) -> set[tuple[int, int, int, str]]:
        e = folded(name)
        n, out = len(e), set()
        for other, m, k in _partners(n, least):
            la, lb = (other, n) if whole else (n, other)
            for i in range(k):
                at, end = lb * i // k, lb * (i + 1) // k
                if whole:
                    out.add((la, lb, i, e[at:end]))
                    continue
                # a segment moves left by letters that only b has, and right by those that only a has
                for x in range(max(0, at - (lb - m)), min(la - (end - at), at + (la - m)) + 1):
                    out.add((la, lb, i, e[x : x + end - at]))
        return out

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                rows = [(name, *k) for name in whole_batch.column("name").slice(at, 256).to_pylist() for k in keys(name)]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["name", "la", "lb", "i", "s"])

    return segments


def _names(df: DataFrame, name: str) -> DataFrame:
    return cut(df.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct())


def _ratio(least: float = 0.0):
    """The ratio of matching blocks; 0 where a bound on it is below `least`."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = (SequenceMatcher(None, folded(p), folded(q)) for p, q in zip(x, y, strict=True))
        return pd.Series([m.ratio() if m.quick_ratio() >= least else 0.0 for m in pairs], dtype="float64")

    return ratio


def _near(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    def keys(names: DataFrame, side: str) -> DataFrame:
        parts = names.mapInArrow(_segments(least, side == "b"), "name string, la int, lb int, i int, s string")
        return parts.select(F.col("name").alias(side), F.xxhash64("la", "lb", "i", "s").alias("k"))

    pairs = keys(a, "a").join(keys(b, "b"), "k").select("a", "b").distinct()
    return pairs.withColumn("ratio", _ratio(least)("a", "b")).filter(F.col("ratio") >= least)


def fuzzy_match(a: DataFrame, b: DataFrame, least: float = 0.82) -> DataFrame:
    """(a, b, ratio): all pairs of different values that are alike, short ones too.  Pairs meet on segments, of which names that reach the ratio share at least one; the ratio is that of matching blocks."""
    return _near(_names(a, "a"), _names(b, "b"), least)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, e, tokens, stems): the folded name, its words of over two letters and the stems of those of over three."""
    strings = pa.list_(pa.string())
    for batch in batches:
        names = batch.column("name").to_pylist()
        e = [folded(n) for n in names]
        found = [re.findall(r"\w+", x) for x in e]
        tokens = [sorted({w for w in ws if len(w) > 2}) for ws in found]
        stems = [sorted({stem(w) for w in ws if len(w) > 3}) for ws in found]
        yield pa.record_batch([batch.column("name"), pa.array(e, pa.string()), pa.array(tokens, strings), pa.array(stems, strings)], names=["name", "e", "tokens", "stems"])


def _inside(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x, y): names of x all of whose tokens are in the name of y; they meet on the token that is rarest in y."""
    own = x.select(F.col("name").alias("x"), F.col("tokens").alias("tx"), F.explode("tokens").alias("t"))
    other = y.select(F.col("name").alias("y"), F.col("tokens").alias("ty"), F.explode("tokens").alias("t"))
    seen = own.join(other.groupBy("t").agg(F.count("*").alias("n")), "t", "left")
    rarest = seen.groupBy("x").agg(F.first("tx").alias("tx"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))["t"].alias("t"))
    return rarest.join(other, "t").filter(F.size(F.array_except("tx", "ty")) == 0).select("x", "y")


def same_entity(a: DataFrame, b: DataFrame, least: float = 0.82) -> DataFrame:
    """(a, b, ratio): all pairs of different names of one entity: alike by ratio, words of one inside the other, exonyms, or words with one stem.  The ratio is below `least` where only another way holds."""
    names_a, names_b = _names(a, "a"), _names(b, "b")
    schema = "name string, e string, tokens array<string>, stems array<string>"
    x, y = (cut(n.mapInArrow(_forms, schema)) for n in (names_a, names_b))
    inside = _inside(x, y).toDF("a", "b").union(_inside(y, x).toDF("b", "a").select("a", "b"))
    both = [*EXONYMS, *((q, p) for p, q in EXONYMS)]
    exonyms = a.sparkSession.createDataFrame(both, "ea string, eb string").distinct()
    exonyms = x.select(F.col("name").alias("a"), F.col("e").alias("ea")).join(F.broadcast(exonyms), "ea").join(y.select(F.col("name").alias("b"), F.col("e").alias("eb")), "eb").select("a", "b")

    def stems(n: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        s = n.select(F.col("name").alias(side), F.explode("stems").alias("s"))
        starts = F.transform(F.sequence(F.lit(4), F.length("s")), lambda k: F.substring(F.col("s"), F.lit(1), k))
        return s, s.filter("length(s) >= 4").select(side, F.explode(starts).alias("s"))

    (sa, starts_a), (sb, starts_b) = stems(x, "a"), stems(y, "b")
    alike = [p.join(q, "s").select("a", "b") for p, q in ((sa, sb), (starts_a, sb), (sa, starts_b))]
    sure = reduce(DataFrame.union, [inside, exonyms, *alike]).distinct()
    near = cut(_near(names_a, names_b, least))
    return near.union(sure.join(near.select("a", "b"), ["a", "b"], "left_anti").withColumn("ratio", _ratio()("a", "b")))
