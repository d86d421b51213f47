"""Audits of drafts and their sources: links, register, titles, factual consistency, reviews, save gate, preflight.

Findings are rows; scores are computed beside the text in one pass.  Rules are arguments with small
defaults.  Null texts count as empty: they give no findings and a score of 100.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..functions import text as T
from ..functions import wikitext as W
from . import rewrites
from .audits import bag_overlap, clamped, grade

# fixed values: (pattern, replacement) of plain and raised words, calques of offices, errors of meaning, machine calques
REGISTER = [("\\bsangat besar\\b", "masif"), ("\\bbanyak sekali\\b", "sejumlah besar"), ("\\bmulai dari\\b", "sejak"), ("\\bmembuat film\\b", "menyutradarai film"), ("\\bsekarang ini\\b", "kini"), ("\\borang-orang\\b", "masyarakat"), ("\\bkasih tahu\\b", "memberi tahu"), ("\\bgak\\b", "tidak")]
OFFICES = [("negara\\s+dependen", "wilayah dependensi"), ("(?:komanderi\\s+administrator|administrator\\s+komanderi)", "Gubernur Komanderi"), ("menteri\\s+pelayan", "Bendahara Rumah Tangga Istana")]
FATAL = [("\\b(?:lahir|dilahirkan)\\b[^.\\n]*\\b(?:pemakaman|dikebumikan)\\b", "birth in a context of death")]
CALQUES = [("\\bmemainkan peran\\b", "play a role"), ("\\bpada akhir hari\\b", "at the end of the day"), ("\\bdalam rangka untuk\\b", "in order to"), ("\\bsalah satu dari\\b", "one of")]
TYPOS = [(f"\\b{a}\\b", b) for a, b in rewrites.SPELLING]
GRAMMAR = [("\\b(Setelah|Ketika|Karena|Meskipun|Walaupun|Jika) ([^,.\\n]+?) (ia|mereka|dia) ", "$1 $2, $3 "), ("\\bbukan (me\\p{Ll}+)", "tidak $1"), ("\\btidak (seorang|sebuah)\\b", "bukan $1"), ("([^,]) (tetapi|melainkan|sedangkan) ", "$1, $2 "), ("\\b(Dan|Tetapi|Sedangkan) ", "")]
WORD_ORDER = [("first_noun", "medium", "\\b(?:pertama|kedua|ketiga) (?:kali|film|album)\\b"), ("adjective_first", "medium", "\\b(?:besar|kecil|baru|lama) (?:kota|rumah|negara)\\b"), ("this_first", "medium", "\\b(?:ini|itu) (?:adalah|film|kota|buku)\\b")]


def has_count(text, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(T.col(text), F.lit("")), F.lit(f"(?i){pattern}"))


def register_score(docs: DataFrame, rules: list[tuple[str, str]] = REGISTER) -> DataFrame:
    """(doc_id, n, score): each rule takes three points for a match, fifteen at most."""
    counts = [has_count("text", p) for p, _ in rules]
    return docs.select("doc_id", sum(counts, F.lit(0)).alias("n"), clamped(sum((F.least(F.lit(15), c * 3) for c in counts), F.lit(0))).alias("score"))


def elevate(text, rules: list[tuple[str, str]] = REGISTER) -> Column:
    return T.rewrite(text, [(f"(?i){p}", r) for p, r in rules])


def grammar(text, rules: list[tuple[str, str]] = GRAMMAR) -> Column:
    """Openers, negation and commas put right, in the order of the rules, between markup."""
    return rewrites.between(T.col(text), rewrites.KEPT, lambda p: T.rewrite(p, rules))


def title_anachronisms(docs: DataFrame, rules: list[tuple[str, str]] = OFFICES) -> DataFrame:
    """(doc_id, found, canonical): calques of old offices."""

    def found(pattern: str, canonical: str) -> Column:
        return F.transform(T.matches("text", f"(?i)\\b{pattern}\\b"), lambda m: F.struct(m.alias("found"), F.lit(canonical).alias("canonical")))

    return docs.select("doc_id", F.inline(F.concat(*(found(p, c) for p, c in rules))))


def link_issues(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(doc_id, raw, issue) of interlanguage links: the title exists (existing: title), is foreign or too general, the code is none, the target is in the target language."""
    rows = docs.select("doc_id", F.inline(W.interlanguage_links("text")))
    if existing is not None:
        rows = rows.join(existing.select("title", F.lit(True).alias("_there")).distinct(), "title", "left")
    else:
        rows = rows.withColumn("_there", F.lit(False))
    issues = F.array(
        F.when(F.col("_there"), "already_exists"), F.when(W.english_title("title"), "english_title"), F.when(W.generic_title("title", "target"), "generic_title"),
        F.when(~W.language_code("lang"), "invalid_code"), F.when(W.target_title("target"), "target_language"),
    )
    return rows.select("doc_id", "raw", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def convert_existing(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc_id, text): interlanguage links to pages that exist become plain links; text is cut at links, looked up as rows and put together in order."""
    parts = F.split("text", "(?=\\{\\{(?:[Ii]ll|[Ii]nterlanguage link)\\|)|(?<=\\}\\})")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    rows = rows.withColumn("link", F.get(W.interlanguage_links("part"), F.lit(0))).withColumn("title", F.col("link.title"))
    rows = rows.join(existing.select("title", F.lit(True).alias("_there")).distinct(), "title", "left")
    label = F.col("link.label")
    new = F.when(F.col("_there"), F.concat(F.lit("[["), F.col("title"), F.when(label.isNotNull() & (label != F.col("title")), F.concat(F.lit("|"), label)).otherwise(F.lit("")), F.lit("]]"))).otherwise(F.col("part"))
    return rows.withColumn("part", new).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("text"))


def factual_consistency(pairs: DataFrame) -> DataFrame:
    """(source_id, draft_id, missing_numbers, source_refs, draft_refs, n_warnings): numbers as bags, references by count, in one row.  Null texts count as empty."""
    numbers = lambda t: T.matches(W.claims(F.coalesce(t, F.lit(""))), T.NUMBER)
    a, b = numbers("source_text"), numbers("draft_text")
    lost = F.size(a) - bag_overlap(a, b)
    refs = lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit("<ref[ >]"))
    rows = pairs.select("source_id", "draft_id", lost.alias("missing_numbers"), refs("source_text").alias("source_refs"), refs("draft_text").alias("draft_refs"))
    return rows.withColumn("n_warnings", (F.col("missing_numbers") > 0).cast("int") + (F.col("draft_refs") < F.col("source_refs")).cast("int"))


def unanchored(pairs: DataFrame) -> DataFrame:
    """(source_id, draft_id, name): names of the draft whose stems stand nowhere in the source."""
    stem = lambda w: F.substring(F.lower(w), 1, 5)
    known = F.array_distinct(F.transform(T.words("source_text"), stem))
    names = F.filter(W.entities("draft_text"), lambda n: F.size(F.array_intersect(F.transform(T.words(n), stem), known)) == 0)
    return pairs.select("source_id", "draft_id", F.explode(names).alias("name"))


def review(pairs: DataFrame, fatal=FATAL, calques=CALQUES, typos=TYPOS) -> DataFrame:
    """(draft_id, n_fatal, n_calques, n_typos, n_reference_issues, score, verdict, completeness): 100 less 25, 6, 3 and 8 points; completeness is the draft's share of the source's words."""
    d, s = F.coalesce("draft_text", F.lit("")), F.coalesce("source_text", F.lit(""))
    n = lambda rules: sum((F.size(F.array_distinct(T.matches(d, f"(?i){p}"))) if rules is fatal else F.regexp_count(d, F.lit(f"(?i){p}")) for p, _ in rules), F.lit(0))
    no_list = F.contains(d, F.lit("<ref")) & ~F.lower(d).rlike("\\{\\{reflist|<references")
    few = F.regexp_count(d, F.lit("\\[\\[(?:Kategori|Category):")) <= 1
    refs = F.aggregate(rewrites.syntax_issues(d), F.lit(0), lambda a, x: a + x["n"]) + no_list.cast("int") + few.cast("int")
    rows = pairs.select("draft_id", n(fatal).alias("n_fatal"), n(calques).alias("n_calques"), n(typos).alias("n_typos"), refs.alias("n_reference_issues"), (F.size(T.words(d)) / F.greatest(F.lit(1), F.size(T.words(s)))).alias("completeness"))
    rows = rows.withColumn("score", clamped(F.expr("n_fatal * 25 + n_calques * 6 + n_typos * 3 + n_reference_issues * 8")))
    return rows.select("draft_id", "n_fatal", "n_calques", "n_typos", "n_reference_issues", "score", W.verdict("score", "n_fatal").alias("verdict"), F.round("completeness", 3).alias("completeness"))


@pandas_udf(IntegerType())
def sentence_lost(before: pd.Series, after: pd.Series) -> pd.Series:
    """How many sentences (arrays of words) of four words or more have under 60 % of their words, as a bag, in the text after."""

    def one(sentences, have) -> int:
        bag = Counter(have)
        return sum(len(w) >= 4 and 10 * sum(min(n, bag[x]) for x, n in Counter(w).items()) < 6 * len(w) for w in sentences)

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype="int32")


def retention(pairs: DataFrame, plain: Callable[[Column], Column] = W.prose) -> DataFrame:
    """(source_id, draft_id, n_sentences, n_lost): sentences of the source with four words or more, and those that the draft has lost; both texts go through `plain`, null texts are empty."""
    a, b = (plain(F.coalesce(c, F.lit(""))) for c in ("source_text", "draft_text"))
    sentences = F.transform(F.split(F.lower(a), "[.!?\\n]+"), lambda s: T.words(s))
    rows = pairs.select("source_id", "draft_id", F.filter(sentences, lambda w: F.size(w) >= 4).alias("s"), T.words(F.lower(b)).alias("have"))
    return rows.select("source_id", "draft_id", F.size("s").alias("n_sentences"), sentence_lost("s", "have").alias("n_lost"))


def escalation(reviewed: DataFrame, least_score: int = 60, least_share: float = 0.4, long_enough: int = 250, fatal: int = 3) -> DataFrame:
    """(draft_id, anew, reasons) of reviews (draft_id, score, n_fatal, n_draft, n_source): an article is translated anew where it has too small a share of a long source, too low a score, or too many fatal findings."""
    reasons = F.array(
        F.when((F.col("n_source") >= long_enough) & (F.col("n_draft") < F.col("n_source") * least_share), "incomplete"), F.when(F.col("score") < least_score, "low score"), F.when(F.col("n_fatal") >= fatal, "fatal findings"),
    )
    return reviewed.select("draft_id", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons")).select("draft_id", (F.size("reasons") > 0).alias("anew"), "reasons")


#: Verbs that report a quotation, in the source and in the draft, and roles as a source phrase, a draft phrase.
SAYS = ("wrote|writes|said|says|stated|noted|recalled|described|argued|called", "menulis|mengatakan|menyatakan|mencatat|mengenang|menggambarkan|menuturkan|menyebut")
ROLES = [("director", "directed by", "disutradarai oleh"), ("maker", "(?:developed|created) by", "(?:dibuat|dikembangkan) oleh")]


def speakers(text: Column, verbs: str) -> Column:
    """Names that a reporting verb and a quotation follow."""
    name = "(?:\\[\\[)?(\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)*)(?:\\]\\])?"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{name},? (?:{verbs})(?: \\p{{Ll}}+)?[,:]? [\"“«]"), F.lit(1)))


def attribution(pairs: DataFrame, roles: list[tuple[str, str, str]] = ROLES) -> DataFrame:
    """(draft_id, kind, name): who the draft quotes but the source does not, and linked roles that the draft gives to another."""
    strange = F.transform(F.array_except(speakers(F.col("draft_text"), SAYS[1]), speakers(F.col("source_text"), SAYS[0])), lambda n: F.struct(F.lit("speaker").alias("kind"), n.alias("name")))

    def turned(kind: str, source: str, draft: str) -> Column:
        a = F.regexp_extract(F.coalesce("source_text", F.lit("")), f"(?i)\\b{source} \\[\\[([^\\]|]+)", 1)
        b = F.regexp_extract(F.coalesce("draft_text", F.lit("")), f"(?i)\\b{draft} \\[\\[([^\\]|]+)", 1)
        return F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.struct(F.lit(kind).alias("kind"), b.alias("name")))

    found = F.filter(F.array(*(turned(*r) for r in roles)), lambda x: x.isNotNull())
    return pairs.select("draft_id", F.inline(F.concat(strange, found)))


def relinked(pairs: DataFrame) -> DataFrame:
    """(draft_id, text, n): names that the source links and the draft has as plain text are linked again, once each, longest first, between markup."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce("source_text", F.lit("")), F.lit("\\[\\[([^\\[\\]|#:]+)"), F.lit(1)))
    outside = F.regexp_replace(F.coalesce("draft_text", F.lit("")), f"(?s){rewrites.KEPT}", "␞")
    wanted = F.filter(names, lambda n: F.contains(outside, n) & ~F.contains(F.coalesce("draft_text", F.lit("")), F.concat(F.lit("[["), n)))
    ordered = F.transform(F.array_sort(F.transform(wanted, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])
    text = F.aggregate(ordered, F.coalesce("draft_text", F.lit("")), lambda acc, n: F.regexp_replace(acc, F.concat(F.lit("(?s)^(.*?)(?<![\\p{L}\\[|])(\\Q"), n, F.lit("\\E)(?![\\p{L}\\]|])")), F.lit("$1[[$2]]")))
    return pairs.select("draft_id", text.alias("text"), F.size(wanted).alias("n"))


def unanchored_sentences(pairs: DataFrame, last: int = 2, least: int = 5) -> DataFrame:
    """(draft_id, sentence): among the last sentences of a draft that has more of them than its source, those with `least` stems or more, none of which the source has."""
    long = lambda t: F.filter(W.sentences(F.coalesce(t, F.lit(""))), lambda s: T.n_matches(s, T.WORD) > 4)
    stems = lambda t: F.array_distinct(F.transform(T.matches(F.lower(t), "[a-z]{4,}"), lambda w: F.substring(w, 1, 5)))
    a, b = long("source_text"), long("draft_text")
    known = stems(F.coalesce("source_text", F.lit("")))
    end = F.slice(b, F.greatest(F.lit(1), F.size(b) - last + 1), last)
    odd = F.filter(end, lambda s: (F.size(stems(s)) >= least) & (F.size(F.array_intersect(stems(s), known)) == 0))
    return pairs.filter(F.size(b) > F.size(a)).select("draft_id", F.explode(odd).alias("sentence"))


def save_gate(pairs: DataFrame) -> DataFrame:
    """(draft_id, accepted, reasons): before (source_text) and after (draft_text) a clean-up: nothing empty, no heading or reference lost, markup in balance, and of each sentence of four words or more 60 % of the words kept."""
    a, b = F.coalesce("source_text", F.lit("")), F.coalesce("draft_text", F.lit(""))
    heads = lambda t: F.regexp_count(t, F.lit("(?m)^={2,6}[^=\\n]+={2,6} *$"))
    refs = lambda t: F.regexp_count(t, F.lit("<ref[ >]"))
    sentences = F.transform(F.split(W.claims(a), "[.!?\\n]+"), lambda s: T.words(F.lower(s)))
    lost = sentence_lost(sentences, T.words(F.lower(W.prose(b)))) > 0
    reasons = F.array(F.when(F.trim(b) == "", "empty"), F.when(heads(b) < heads(a), "heading lost"), F.when(refs(b) < refs(a), "reference lost"), F.when(F.size(rewrites.syntax_issues(b)) > 0, "unbalanced"), F.when(lost, "sentence lost"))
    return pairs.select("draft_id", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons")).select("draft_id", (F.size("reasons") == 0).alias("accepted"), "reasons")


def section_gate(sections: DataFrame) -> DataFrame:
    """(draft_id, idx, reason) of the i-th source section against the i-th draft section (draft_id, idx, source_text, draft_text): empty, short, reversed, numbers or references lost."""
    a, b = F.coalesce("source_text", F.lit("")), F.coalesce("draft_text", F.lit(""))
    n, m = F.size(T.words(a)), F.size(T.words(b))
    x, y = T.matches(a, "[0-9]{3,}"), T.matches(b, "[0-9]{3,}")
    lost = F.size(x) - bag_overlap(x, y)
    turned = F.lower(a).rlike("\\b(?:opposed|prohibited|decreased|failed)\\b") & F.lower(b).rlike("\\b(?:mendukung|mengizinkan|meningkat|berhasil)\\b")
    refs = lambda t: F.regexp_count(t, F.lit("<ref[ >]"))
    reason = F.when((m == 0) & (n > 0), "empty").when(m * 100 < n * 15, "short").when(turned, "reversed").when(lost >= 4, "numbers").when(refs(b) < refs(a), "references").otherwise("ok")
    return sections.select("draft_id", "idx", reason.alias("reason"))


def sorted_violations(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, violations): array of (line, rule, severity, found) in order of line and rule; markup that is no prose is skipped."""

    def on_line(line: Column, i: Column, name: str, severity: str, pattern: str) -> Column:
        return F.transform(T.matches(F.regexp_replace(line, rewrites.KEPT, ""), f"(?i){pattern}"), lambda m: F.struct((i + 1).alias("line"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), m.alias("found")))

    found = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.concat(*(on_line(line, i, *r) for r in rules))))
    return docs.select("doc_id", F.array_sort(found).alias("violations"))


def word_order_score(docs: DataFrame, rules: list[tuple[str, str, str]] = WORD_ORDER) -> DataFrame:
    """(doc_id, n, score): five points for each issue."""
    n = sum((has_count(F.regexp_replace("text", rewrites.KEPT, ""), p) for _, _, p in rules), F.lit(0))
    return docs.select("doc_id", n.alias("n"), clamped(n * 5).alias("score"))


def preflight(pages: DataFrame, rendered: DataFrame, headers: list[str]) -> DataFrame:
    """(title, templates, categories, rendered_categories, header_templates): what a page uses; rendered: (title, category)."""
    names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("\\{\\{ *([^{}|\\n#:]+)"), F.lit(1)), lambda x: W.title_in(x))))
    cats = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("\\[\\[(?:Category|Kategori): *([^\\]|]+)"), F.lit(1)), T.title)))
    rows = pages.select("title", names.alias("templates"), cats.alias("categories"))
    seen = rendered.groupBy("title").agg(F.array_sort(F.collect_set("category")).alias("rendered_categories"))
    head = F.filter("templates", lambda t: F.lower(t).isin(*headers) | F.lower(t).rlike("(?: year| decade| century) category$"))
    return rows.join(seen, "title", "left").select("title", "templates", "categories", F.coalesce("rendered_categories", F.array().cast("array<string>")).alias("rendered_categories"), head.alias("header_templates"))


def documentation_gaps(templates: DataFrame) -> DataFrame:
    """(title, issue) of template pages (title, text, doc): parameters without documentation, documentation without a parameter, no documentation, no TemplateData."""
    used = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("\\{\\{\\{([^{}|]+)"), F.lit(1)), lambda x: F.trim(x)))
    told = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("doc", F.lit("")), F.lit("\\| *([^=|\\n]+?) *="), F.lit(1)), lambda x: F.trim(x)))
    issues = F.concat(
        F.transform(F.array_except(used, told), lambda p: F.concat(F.lit("undocumented: "), p)), F.transform(F.array_except(told, used), lambda p: F.concat(F.lit("unknown: "), p)),
        F.filter(F.array(F.when(F.coalesce(F.trim("doc"), F.lit("")) == "", "no documentation"), F.when(~F.contains(F.coalesce("doc", F.lit("")), F.lit("<templatedata>")), "no TemplateData")), lambda x: x.isNotNull()),
    )
    return templates.select("title", F.explode(issues).alias("issue"))


def openers_in_a_row(text: Column) -> Column:
    """Sentences that begin with the word that the sentence before them begins with."""
    first = F.transform(W.sentences(text, 1), lambda s: F.lower(F.regexp_extract(s, "^[^\\p{L}\\p{N}]*([\\p{L}\\p{N}]+)", 1)))
    return F.size(F.filter(first, lambda w, i: (i > 0) & (w != "") & (w == F.get(first, i - 1))))


def quality_layers(pairs: DataFrame, fatal=FATAL, register=REGISTER, typos=TYPOS) -> DataFrame:
    """(draft_id, draft, language, technique, critical, total, grade, approved): three layers of a draft against its source.

    Draft: share of the source's words, numbers and references kept.  Language: half naturalness
    (register 0.5, openers 0.3, sentence length 0.2), half spelling.  Technique: open markup, reference
    list, categories.  The total weighs them 0.25, 0.45 and 0.30 and stays at 65 or less with a fatal
    finding or an empty draft.
    """
    d, s = F.coalesce("draft_text", F.lit("")), F.coalesce("source_text", F.lit(""))
    a, b = T.matches(W.claims(s), T.NUMBER), T.matches(W.claims(d), T.NUMBER)
    refs = lambda t: F.regexp_count(t, F.lit("<ref[ >]"))
    hits = lambda rules: sum((F.regexp_count(d, F.lit(f"(?i){p}")) for p, _ in rules), F.lit(0))
    rows = pairs.select(
        "draft_id", (F.size(T.words(d)) * 100).alias("share"), F.greatest(F.lit(1), F.size(T.words(s))).alias("n_source"), (F.size(a) - bag_overlap(a, b)).alias("lost"), (refs(d) < refs(s)).alias("fewer"),
        sum((F.least(F.lit(15), F.regexp_count(d, F.lit(f"(?i){p}")) * 3) for p, _ in register), F.lit(0)).alias("plain"), openers_in_a_row(W.prose(d)).alias("openers"), W.average_sentence_length(W.prose(d)).alias("length"), hits(typos).alias("typos"),
        F.aggregate(rewrites.syntax_issues(d), F.lit(0), lambda acc, x: acc + x["n"]).alias("open"), (F.contains(d, F.lit("<ref")) & ~F.lower(d).rlike("\\{\\{reflist|<references")).alias("no_list"), (F.regexp_count(d, F.lit("\\[\\[(?:Kategori|Category):")) <= 1).alias("few"),
        ((hits(fatal) > 0) | (F.trim(d) == "")).alias("critical"),
    )
    draft = clamped(F.when(F.col("share") < F.col("n_source") * 50, 30).otherwise(0) + F.least(F.lit(40), F.col("lost") * 5) + F.when(F.col("fewer"), 10).otherwise(0))
    natural = clamped(F.col("plain")) * 0.5 + clamped(F.least(F.lit(50), F.col("openers") * 10)) * 0.3 + clamped(F.when(F.col("length") > 35, 40).when(F.col("length") > 25, 15).otherwise(0)) * 0.2
    language = (natural * 0.5 + clamped(F.least(F.lit(60), F.col("typos") * 3)) * 0.5).cast("int")
    technique = clamped(F.least(F.lit(60), F.col("open") * 10) + F.when(F.col("no_list"), 10).otherwise(0) + F.when(F.col("few"), 10).otherwise(0))
    rows = rows.select("draft_id", draft.cast("int").alias("draft"), language.alias("language"), technique.cast("int").alias("technique"), "critical")
    total = F.expr("CAST((draft * 25 + language * 45 + technique * 30) / 100 AS INT)")
    rows = rows.withColumn("total", F.when(F.col("critical"), F.least(F.lit(65), total)).otherwise(total))
    return rows.select("*", grade(F.col("total")).alias("grade"), ((F.col("total") >= 80) & ~F.col("critical")).alias("approved"))
