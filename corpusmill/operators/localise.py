"""Rewrites for a target language: currency, units, templates, banners, redirects, categories, archives.

Rules are rows (pattern, replacement) applied in order as JVM regular expressions; text inside
links, references and code is left alone by `prose_only`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: words and names of the target wiki
SCALES = [("million", "juta"), ("billion", "miliar"), ("thousand", "ribu"), ("trillion", "triliun")]
SHORT_SCALES = [("M", "juta"), ("B", "miliar"), ("K", "ribu")]
UNITS = [("square miles?", "mil persegi"), ("square feet", "kaki persegi"), ("miles?", "mil"), ("mi", "mil"), ("feet|foot", "kaki"), ("ft", "kaki"), ("inch(?:es)?", "inci"), ("in", "inci"), ("pounds?", "pon"), ("lbs?", "pon")]
TEMPLATES = [("Main", "Utama"), ("See also", "Lihat pula"), ("Reflist", "Daftar rujukan")]
BANNERS = {
    "film": ["Film"], "cinema": ["Film"], "tv_series": ["Televisi"], "television": ["Televisi"], "computing_science": ["Komputasi", "Sains"],
    "physics_mathematics": ["Fisika", "Matematika", "Sains"], "medical_biology": ["Biologi", "Kedokteran", "Sains"], "history_social": ["Sejarah"],
}

NUMBER = "[0-9]+(?:[.,][0-9]+)*"
#: Stretches that no rewrite touches.
PROTECTED = "\\[\\[[^\\]]*\\]\\]|\\{\\{[^}]*\\}\\}|<ref[^>]*>[^<]*</ref>|<code>[^<]*</code>|<nowiki>[^<]*</nowiki>"

#: Where a word begins and ends: letters of every script, digits and marks on letters are in words, whatever \\b means to a JVM.
WORDS = "\\p{L}\\p{Nd}\\p{Mn}_"
BEGINS, ENDS = f"(?<![{WORDS}])", f"(?![{WORDS}])"

CURRENCY_RULES = [
    *((f"([$£€¥])({NUMBER}) {a}{ENDS}", f"$1$2 {b}") for a, b in SCALES),
    *((f"([$£€¥])({NUMBER}){a}{ENDS}", f"$1$2 {b}") for a, b in SHORT_SCALES),
    ("(^|[^A-Za-z])\\$([0-9])", "$1US\\$$2"),
]
UNIT_RULES = [(f"{BEGINS}({NUMBER}) (?:{a}){ENDS}", f"$1 {b}") for a, b in UNITS]
METRIC_RULES = [
    (f"\\b({NUMBER}) (?:ft|feet) ({NUMBER}) (?:in|inches) \\(({NUMBER}) (cm|m)\\)", "$3 $4 ($1 kaki $2 inci)"),
    (f"\\b({NUMBER}) (?:miles?|mi) \\(({NUMBER}) km\\)", "$2 km ($1 mil)"),
    (f"\\b({NUMBER}) (?:feet|ft) \\(({NUMBER}) m\\)", "$2 m ($1 kaki)"),
    (f"\\b({NUMBER}) (?:pounds?|lbs?) \\(({NUMBER}) kg\\)", "$2 kg ($1 pon)"),
]


def prose_only(text, change) -> Column:
    """`change` applied between protected stretches: the text is cut at them, and pieces and stretches are put together again by turns."""

    def rewritten(t: Column) -> Column:
        kept = F.regexp_extract_all(t, F.lit(PROTECTED), F.lit(0))
        return T.bound(kept, lambda k: F.array_join(F.transform(F.split(t, PROTECTED), lambda p, i: F.concat(change(p), F.coalesce(F.get(k, i), F.lit("")))), ""))

    return T.bound(T.col(text), rewritten)


def currency(text) -> Column:
    return prose_only(text, lambda p: T.rewrite(p, CURRENCY_RULES))


def units(text) -> Column:
    return prose_only(text, lambda p: T.rewrite(p, UNIT_RULES))


def metric_first(text) -> Column:
    """Metric values before imperial ones; then remaining units."""
    return prose_only(text, lambda p: T.rewrite(p, METRIC_RULES))


def templates(text, available: list[str] | None = None) -> Column:
    """Template names in the target language; others that are not available go into a comment."""
    t = T.rewrite(text, [(f"\\{{\\{{{a}(\\||\\}})", f"{{{{{b}$1") for a, b in TEMPLATES])
    if available is None:
        return t
    known = "|".join([*(b for _, b in TEMPLATES), *available])
    return F.regexp_replace(t, f"\\{{\\{{(?!(?:{known})\\s*[|}}])([^{{}}]*)\\}}\\}}", "<!-- Templat belum tersedia di id.wiki: {{$1}} -->")


def attribution(pages: DataFrame) -> DataFrame:
    """(title, topic, revision) with content: where a translation comes from, and the project banners of its topic."""
    banner = F.create_map(*(x for k, v in BANNERS.items() for x in (F.lit(k), F.lit("\n".join(f"{{{{ProyekWiki {b}}}}}" for b in v)))))
    head = F.format_string("{{Diterjemahkan dari|en|%s|version=%s}}", F.translate("title", " ", "_"), F.col("revision").cast("string"))
    return pages.withColumn("content", F.concat_ws("\n", head, banner[F.col("topic")]))


def redirects(pages: DataFrame) -> DataFrame:
    """(title, target, reason): other names under which a page is looked for, the first reason of each kept."""
    t, src = F.col("target"), F.col("source")
    plain = F.translate(t, "–—’‘“”", "--''\"\"")
    bare = F.trim(F.regexp_replace(t, " \\([^()]*\\)$", ""))
    options = F.array(F.struct(src.alias("title"), F.lit(0).alias("p"), F.lit("english_name").alias("reason")), F.struct(plain.alias("title"), F.lit(1).alias("p"), F.lit("punctuation").alias("reason")), F.struct(bare.alias("title"), F.lit(2).alias("p"), F.lit("without_disambiguator").alias("reason")))
    rows = pages.select("target", F.inline(options)).filter("title <> '' AND title <> target")
    return rows.groupBy("title", "target").agg(F.min_by("reason", "p").alias("reason"))


def split_category(name) -> Column:
    """Parts of a category name such as '1990s American drama films': decade or year, then words."""
    n = T.col(name)
    return F.filter(F.array(F.regexp_extract(n, "^([0-9]{4}s?) ", 1), F.regexp_extract(n, "(\\p{Lu}[\\p{L}-]+) ", 1), F.regexp_extract(n, "([\\p{L}-]+)$", 1)), lambda x: x != "")


def missing_archives(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, url): cited addresses without an archived copy."""
    cites = F.regexp_extract_all(F.col(text), F.lit("\\{\\{[Cc]ite [^{}]*\\}\\}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(cites).alias("c")).filter("NOT contains(c, 'archive-url')")
    return rows.select("doc_id", F.regexp_extract("c", "\\|\\s*url\\s*=\\s*([^|}\\s]+)", 1).alias("url")).filter("url <> ''").distinct()


def inject_archives(docs: DataFrame, snapshots: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with archive-url and archive-date added to citations whose address is in snapshots (url, archive_url, archive_date)."""
    parts = F.split(F.col(text), "(?=\\{\\{[Cc]ite )|(?<=\\}\\})")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    open_cite = F.col("part").rlike("^\\{\\{[Cc]ite [^{}]*\\}\\}$") & ~F.contains("part", F.lit("archive-url"))
    rows = rows.withColumn("url", F.when(open_cite, F.nullif(F.regexp_extract("part", "\\|\\s*url\\s*=\\s*([^|}\\s]+)", 1), F.lit(""))))
    rows = rows.join(snapshots, "url", "left")
    extra = F.format_string("|archive-url=%s |archive-date=%s |url-status=live}}", "archive_url", "archive_date")
    new = F.when(F.col("archive_url").isNotNull(), F.concat(F.expr("substring(part, 1, length(part) - 2)"), extra)).otherwise(F.col("part"))
    rows = rows.withColumn("part", new)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("text"))


def metadata_path(user: str, title, project="Draf", month=None) -> Column:
    """Where a draft of a month is put."""
    m = F.date_format(F.current_date(), "yyyy-MM") if month is None else T.col(month)
    return F.concat_ws("/", F.lit(f"Pengguna:{user}"), F.lit("Bak_pasir"), F.lit(project), m, F.translate(T.col(title), " ", "_"))


def term_state(log: DataFrame) -> DataFrame:
    """State of candidate terms from a log (term, target, action, ts): proposed, approved or rejected last, and how often used."""
    status = F.max_by(F.when(F.col("action") != "use", F.col("action")), F.when(F.col("action") != "use", F.struct("ts", "action")))
    return log.groupBy("term", "target").agg(status.alias("status"), F.count(F.when(F.col("action") == "use", 1)).alias("usage_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def mine_pairs(threads: DataFrame, text: str = "text") -> DataFrame:
    """(thread_id, term, target): 'term = target' and 'term → target' lines of discussions, the last of each term winning."""
    found = F.regexp_extract_all(F.col(text), F.lit('(?m)^[*#:]* *[\'"]*([\\p{L}][\\p{L} -]{1,60}?)[\'"]* *(?:=|→|->) *[\'"]*([\\p{L}][\\p{L} -]{1,60}?)[\'"]* *$'), F.lit(0))
    rows = threads.select("thread_id", F.posexplode(found).alias("pos", "raw"))
    parts = F.split(F.regexp_replace("raw", "^[*#: ]+", ""), " *(?:=|→|->) *")
    clean = lambda c: F.trim(F.regexp_replace(c, "['\"]", ""))
    rows = rows.select("thread_id", "pos", F.lower(clean(parts[0])).alias("term"), clean(parts[1]).alias("target"))
    return rows.groupBy("term").agg(F.max_by(F.struct("target", "thread_id"), F.struct("thread_id", "pos")).alias("r")).select("r.thread_id", "term", "r.target")
