"""Meaning and style of aligned sentences and drafts, driven by rule tables; gates and plans.

Every audit gives findings as rows (…, rule, severity, detail); scores are sums over findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audits import clamped

# fixed values: words of the source and, in the draft, words that turn the meaning round
POLARITY = [
    ("oppose|opposed|opposes", "mendukung|menyokong"),
    ("support|supported|supports", "menentang|menolak"),
    ("prohibit|prohibited|prohibits|forbid|forbidden", "mengizinkan|memperbolehkan"),
    ("permit|permitted|permits|allow|allowed|allows", "melarang|mengharamkan"),
    ("innocent", "bersalah"),
    ("guilty", "tidak bersalah"),
    ("increase|increased|increases|rise|rose|grow|grown|grows", "menurun|merosot|anjlok|berkurang"),
    ("decrease|decreased|decreases|drop|dropped|fall|fell|shrink|shrank", "meningkat|melonjak|bertambah"),
    ("succeed|succeeded|succeeds|success|successful", "gagal|kandas"),
    ("fail|failed|fails|failure", "berhasil|sukses"),
    ("benign", "ganas"),
    ("malignant", "jinak"),
    ("toxic", "aman"),
    ("safe", "beracun"),
]
MODALITY = [
    ("may|might|could|possibly|potentially", "pasti|tentu|sudah jelas|tak dapat disangkal"),
    ("alleged|allegedly|claimed|purported|reportedly", "terbukti|terkonfirmasi|secara faktual"),
]
#: Forms that take a direction for the name of a sea.  The correct word for southeast is no error.
COMPASS = [("northeast", "timur Laut"), ("northwest", "barat Laut"), ("southwest", "barat Daya")]
#: An object pronoun behind a past form, told by its ending; the draft then speaks of the subject itself.
OTHER_PERSON = "\\p{Ll}{2,}(?:ed|nd|st|wn)\\s+(?:him|her|them)"
ITSELF = "dirinya(?!\\s+sendiri)"
#: Words before a particle that stands apart, and bound forms; defaults where a caller brings no knowledge table.
APART = ["apa", "dia", "kapan", "mana", "mereka", "siapa"]
BOUND = ["anti", "multi", "non", "pasca", "pra", "sub", "swa", "tuna", "ultra"]

PENALTY = {"critical": 15, "high": 10, "medium": 5}


def has(text: Column, words: str, fold: bool = True) -> Column:
    return text.rlike(f"{'(?i)' if fold else ''}\\b(?:{words})\\b")


#: Rules of a table that are held as literals in the row.
MOST_RULES = 1_000


def default_rules(spark: SparkSession) -> DataFrame:
    """(rule, severity, source, draft, folded): what stands in the source, and what in the draft then turns its meaning."""
    rows = [("polarity", "critical", a, b, True) for a, b in POLARITY] + [("modality", "high", a, b, True) for a, b in MODALITY] + [("compass", "high", a, b, False) for a, b in COMPASS]
    rows.append(("reflexive", "critical", OTHER_PERSON, ITSELF, True))
    return spark.createDataFrame(rows, "rule string, severity string, source string, draft string, folded boolean")


def sentence_findings(pairs: DataFrame, rules: DataFrame | None = None, unowned: list[str] = ()) -> DataFrame:
    """(pair_id, rule, severity, detail) for aligned sentences (pair_id, source, draft): the rules of a table that hold, and owners (X's thing) that the draft does not name.

    Null sentences count as empty.  An owner is a name: a word that the sources write small somewhere is none, nor one that the caller lists.
    """
    table = (default_rules(pairs.sparkSession) if rules is None else rules).limit(MOST_RULES + 1).collect()
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    s, d = F.coalesce("source", F.lit("")), F.coalesce("draft", F.lit(""))
    hits = [F.when(has(s, r["source"]) & has(d, r["draft"], r["folded"]), F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(f"{r['source']} / {r['draft']}").alias("detail"))) for r in table]
    ruled = pairs.select("pair_id", F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    owners = F.regexp_extract_all(s, F.lit("(?<![\\p{L}'])(\\p{Lu}\\p{Ll}+)'s\\s+\\p{Ll}"), F.lit(1))
    missing = F.filter(owners, lambda o: ~F.contains(F.lower(d), F.lower(o)))
    owned = pairs.select("pair_id", F.explode(missing).alias("detail")).withColumn("small", F.lower("detail"))
    small = pairs.select(F.explode(F.array_distinct(F.regexp_extract_all(s, F.lit("(?<![\\p{L}'])\\p{Ll}+"), F.lit(0)))).alias("small")).distinct()
    owned = owned.join(small, "small", "left_anti").filter(~F.col("small").isin(*unowned) if unowned else F.lit(True))
    return ruled.unionByName(owned.select("pair_id", F.lit("owner").alias("rule"), F.lit("critical").alias("severity"), "detail"))


def scored(findings: DataFrame, ids: DataFrame, key: str, penalty: dict[str, int] = PENALTY) -> DataFrame:
    """(key, n, score, passed) for every id, also those without findings."""
    points = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in penalty.items()), F.lit(0))
    sums = findings.groupBy(key).agg(F.count("*").alias("n"), F.sum(points).alias("p"))
    out = ids.select(key).distinct().join(sums, key, "left").fillna(0, ["n", "p"])
    return out.select(key, "n", clamped(F.col("p")).alias("score"), (F.col("n") == 0).alias("passed"))


def rule_findings(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, line, rule, severity, detail): matches of (name, severity, pattern) in prose lines; tables, categories and comments are skipped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter("trim(t) <> ''").filter(~F.col("t").rlike("^\\s*(?:\\{\\||\\||!|\\[\\[(?:Kategori|Category):|<!--)"))
    clean = F.regexp_replace(F.regexp_replace("t", "<ref[^>/]*>.*?</ref>|<ref[^>]*/>", ""), "\\{\\{[^{}]*\\}\\}", "")
    found = F.concat(*(_matches(*r) for r in rules))
    return lines.select("doc_id", (F.col("line") + 1).alias("line"), clean.alias("t")).select("doc_id", "line", F.inline(found))


def _matches(name: str, severity: str, pattern: str) -> Column:
    found = F.regexp_extract_all("t", F.lit(f"(?i){pattern}"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), m.alias("detail")))


def guarded_rewrites(docs: DataFrame, rules: list[tuple[list[str], str, str]]) -> DataFrame:
    """`docs` with text rewritten by (context words, pattern, replacement); a rule holds only where a context word is in the text."""
    t, low = F.col("text"), F.lower("text")
    for context, pattern, replacement in rules:
        there = F.lit(True) if not context else F.exists(F.array(*map(F.lit, context)), lambda w: F.contains(low, F.lower(w)))
        t = F.when(there, F.regexp_replace(t, f"(?i){pattern}", replacement)).otherwise(t)
    return docs.withColumn("text", t)


def orthography(text: Column, apart: list[str] = APART, bound: list[str] = BOUND) -> Column:
    """The particle pun apart from the words on the list; bound forms joined to a small letter, hyphenated before a capital."""
    t = F.regexp_replace(text, f"\\b({'|'.join(apart)})pun\\b", "$1 pun")
    t = F.regexp_replace(t, f"\\b({'|'.join(bound)}) (\\p{{Lu}})", "$1-$2")
    return F.regexp_replace(t, f"\\b({'|'.join(bound)})[- ](\\p{{Ll}})", "$1$2")


def publish_gate(plans: DataFrame, live: DataFrame, blockers: DataFrame, allow_existing: bool = False) -> DataFrame:
    """(title, approved, reasons): plans (title, content, content_sha256, approved_by, expected_revision) against live pages (title, revision) and blockers (title, reason)."""
    b = blockers.groupBy("title").agg(F.array_sort(F.collect_set("reason")).alias("b"))
    rows = plans.join(live, "title", "left").join(b, "title", "left")
    reasons = F.array(
        F.when(F.sha2("content", 256) != F.col("content_sha256"), F.lit("content changed since approval")),
        F.when(F.col("approved_by").isNull(), F.lit("not approved")),
        F.when(F.col("revision").isNotNull() & F.lit(not allow_existing), F.lit("target exists")),
        F.when(F.col("expected_revision").isNotNull() & ~F.col("revision").eqNullSafe(F.col("expected_revision")), F.lit("revision changed")),
    )
    rows = rows.withColumn("reasons", F.concat(F.filter(reasons, lambda r: r.isNotNull()), F.coalesce("b", F.array().cast("array<string>"))))
    return rows.select("title", (F.size("reasons") == 0).alias("approved"), "reasons")


def category_plan(source: DataFrame, langlinks: DataFrame, target: DataFrame) -> DataFrame:
    """(category, members, resolved, existing, candidates, unresolved): source and target are (category, member); langlinks (member, target)."""
    have = target.select("category", F.lower("member").alias("k"), F.lit(1).alias("have")).distinct()
    rows = source.distinct().join(langlinks, "member", "left").withColumn("k", F.lower("target")).join(have, ["category", "k"], "left")
    hit = F.col("target").isNotNull()
    return rows.groupBy("category").agg(
        F.count("*").alias("members"), F.count("target").alias("resolved"), F.count("have").alias("existing"),
        F.array_sort(F.collect_set(F.when(hit & F.col("have").isNull(), F.col("target")))).alias("candidates"), F.array_sort(F.collect_set(F.when(~hit, F.col("member")))).alias("unresolved"),
    )


def claim_review(reviews: DataFrame) -> DataFrame:
    """(review_id, accepted): model answers as JSON, with source and draft.  Accepted only if complete, every claim is supported and every quote stands in its text; anything unreadable is refused."""
    kind = "complete boolean, claims array<struct<source_quote:string,draft_quote:string,status:string>>, additions array<struct<draft_quote:string>>"
    j = F.from_json("answer", kind)
    rows = reviews.select("review_id", "source", "draft", j.alias("j"))
    quoted = F.forall("j.claims", lambda c: F.contains(F.col("source"), c["source_quote"]) & F.contains(F.col("draft"), c["draft_quote"]) & (c["status"] == "supported"))
    ok = F.col("j.complete") & (F.size("j.claims") > 0) & quoted & (F.coalesce(F.size("j.additions"), F.lit(0)) <= 0)
    return rows.select("review_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def stream_text(lines: DataFrame) -> DataFrame:
    """(request_id, text): parts of server-sent events in order; empty unless the stream ended with its final mark and every line could be read."""
    data = lines.filter("startswith(line, 'data:')").withColumn("body", F.trim(F.expr("substring(line, 6)")))
    data = data.withColumn("part", F.get_json_object("body", "$.text")).withColumn("stop", F.coalesce(F.get_json_object("body", "$.finish") == "STOP", F.lit(False)))
    g = data.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("part", F.lit("")).alias("part")))).alias("p"), F.max_by("stop", "line_no").alias("ended"), F.max(F.expr("try_parse_json(body) IS NULL")).alias("broken"))
    return g.select("request_id", F.when(F.col("ended") & ~F.col("broken"), F.array_join(F.transform("p", lambda x: x["part"]), "")).otherwise("").alias("text"))
