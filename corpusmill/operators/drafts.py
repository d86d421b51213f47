"""Drafts and plans as rows: stubs, tables, navigation boxes, templates, categories, letters, snapshots, dictionary services, mining of discussions.

Decisions are joins and conditions; the text at the end is string assembly.  Nothing is published
here: what would be written is a plan row.  Null parts are left out of a text; empty tables give
empty plans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions import wikitext as W
from . import rewrites
from .ordered import keep_first

# fixed values: labels and names of the target wiki
LABELS = [("name", "nama"), ("title", "judul"), ("image", "gambar"), ("birth_date", "tanggal_lahir"), ("death_date", "tanggal_meninggal"), ("occupation", "pekerjaan"), ("director", "sutradara"), ("starring", "pemeran"), ("country", "negara"), ("language", "bahasa"), ("state", "state"), ("group", "grup"), ("list", "daftar")]
CELL_WORDS = [("Yes", "Ya"), ("No", "Tidak"), ("Won", "Menang"), ("Nominated", "Nominasi"), ("TBA", "Belum diumumkan"), ("Film", "Film"), ("Year", "Tahun"), ("Title", "Judul"), ("Role", "Peran"), ("Notes", "Catatan")]
NOISE = "\\b(?:tanya|tolong|salam|terima kasih|halo|mohon)\\b"
#: Stems of cue words, by what they say of the form that follows: that a linked term turns into it, or that it is put forward.  Defaults; a caller brings a table.
CUES = {"becomes": ["jadi", "padan"], "proposes": ["usul", "padan", "terjemah", "setuju", "sepakat", "kbbi"]}
#: Words that may stand between a cue and what it speaks of.
CUE_GAP = 3
REMARKS = [("translationese", ["kalkir", "terjemah"]), ("orthography", ["baku", "eyd", "kbbi"]), ("punctuation", ["koma", "tanda baca"])]
TERM_LETTERS, QUOTE_LETTERS, LEAST_REMARK = (3, 35), (5, 150), 8
FUNCTION_WORDS = ["pada", "dari", "ke", "itu", "ini", "yang", "dan"]


def mapped(value, pairs: list[tuple[str, str]]) -> Column:
    v = T.col(value)
    return F.coalesce(*(F.when(F.lower(v) == a.lower(), b) for a, b in pairs), v)


def link(target, label=None) -> Column:
    t = T.col(target)
    return F.concat(F.lit("[["), t, F.lit("]]")) if label is None else F.when(t == T.col(label), F.concat(F.lit("[["), t, F.lit("]]"))).otherwise(F.concat(F.lit("[["), t, F.lit("|"), T.col(label), F.lit("]]")))


# articles ---------------------------------------------------------------------------------


def stub_parts(pages: DataFrame) -> DataFrame:
    """(title, infobox, lead, works, external, navboxes) of source pages (title, text)."""
    t = F.col("text")
    section = lambda names: F.trim(F.regexp_extract(t, f"(?s)(?:^|\\n)==+ *(?:{names}) *==+\\n(.*?)(?=\\n==|$)", 1))
    body = F.regexp_replace(t, "(?s)\\n==.*$", "")
    lead = F.get(F.filter(F.split(W.without_templates(body), "\n+"), lambda p: F.length(F.trim(p)) > 0), F.lit(0))
    return pages.select(
        "title", F.regexp_extract(t, "(?s)(\\{\\{Infobox(?:[^{}]|\\{\\{[^{}]*\\}\\})*\\}\\})", 1).alias("infobox"), F.trim(lead).alias("lead"), section("Filmography|Works|Discography|Bibliography").alias("works"), section("External links").alias("external"),
        F.regexp_extract_all(t, F.lit("\\{\\{([^{}|\\n]*[Nn]avbox[^{}|\\n]*)"), F.lit(1)).alias("navboxes"),
    )


def stubs(pages: DataFrame, titles: DataFrame, templates: DataFrame, stub_of: list[tuple[str, str]]) -> DataFrame:
    """(source, title, content, accepted): stub articles.  titles: (source, local) names chosen before; templates: (template) that exist; stub_of: (topic, stub template).  A stub without a lead is not accepted."""
    p = stub_parts(pages).join(titles.select(F.col("source").alias("title"), "local"), "title", "left")
    name = F.coalesce("local", W.localised_title("title"))
    boxes = p.select("title", F.explode("navboxes").alias("template")).join(templates, "template", "left_semi").groupBy("title").agg(F.array_sort(F.collect_set(F.concat(F.lit("{{"), F.col("template"), F.lit("}}")))).alias("boxes"))
    topic = W.topic("lead")
    stub = F.coalesce(*(F.when(topic == a, F.lit(f"{{{{{b}}}}}")) for a, b in stub_of), F.lit("{{rintisan}}"))
    out = p.join(boxes, "title", "left")
    parts = [F.nullif(F.col("infobox"), F.lit("")), F.nullif(F.col("lead"), F.lit("")), F.when(F.col("works") != "", F.concat(F.lit("== Karya ==\n"), F.col("works"))), F.when(F.col("external") != "", F.concat(F.lit("== Pranala luar ==\n"), F.col("external"))), F.nullif(F.array_join("boxes", "\n"), F.lit("")), stub]
    return out.select(F.col("title").alias("source"), name.alias("title"), F.concat_ws("\n\n", *parts).alias("content"), (F.length(F.coalesce("lead", F.lit(""))) > 0).alias("accepted"))


def table_cells(docs: DataFrame, words: list[tuple[str, str]] = CELL_WORDS) -> DataFrame:
    """(doc_id, text): tables with each cell put through the words, row by row; everything else stays."""

    def cell(c: Column) -> Column:
        return F.regexp_replace(F.concat(F.regexp_extract(c, "^(\\s*)", 1), mapped(F.trim(c), words), F.regexp_extract(c, "(\\s*)$", 1)), "^\\s+$", "")

    def row(line: Column) -> Column:
        mark = F.regexp_extract(line, "^([|!])", 1)
        cells = F.split(line.substr(F.lit(2), F.length(line)), "\\|\\||!!")
        joined = F.array_join(F.transform(cells, cell), "||")
        return F.when(line.rlike("^[|!](?![-}+])"), F.concat(mark, F.when(mark == "!", F.replace(joined, F.lit("||"), F.lit("!!"))).otherwise(joined))).otherwise(line)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), row), "\n").alias("text"))


def parameters(docs: DataFrame, key: str = "title") -> DataFrame:
    """(key, pos, name, value) of the first template of a text, by the lines '| name = value'."""
    lines = F.regexp_extract_all("text", F.lit("(?m)^ *\\| *[^=|\\n]+=[^\\n]*"), F.lit(0))
    rows = docs.select(key, F.posexplode(lines).alias("pos", "line"))
    return rows.select(key, "pos", F.trim(F.regexp_extract("line", "^ *\\| *([^=]+?) *=", 1)).alias("name"), F.trim(F.regexp_extract("line", "=(.*)$", 1)).alias("value"))


def navboxes(docs: DataFrame, mapping: DataFrame, labels: list[tuple[str, str]] = LABELS) -> DataFrame:
    """(title, content): navigation boxes with parameter names from the labels and links from mapping (target, mapped)."""
    p = parameters(docs)
    number = F.regexp_extract("name", "([0-9]*)$", 1)
    p = p.withColumn("name", F.concat(mapped(F.regexp_replace("name", "[0-9]*$", ""), labels), number))
    parts = p.select("title", "pos", "name", F.posexplode(F.split("value", "(?=\\[\\[)|(?<=\\]\\])")).alias("at", "part"))
    parts = parts.withColumn("target", F.when(F.col("part").rlike("^\\[\\["), F.regexp_extract("part", "^\\[\\[([^|\\]]+)", 1))).join(mapping, "target", "left")
    new = F.when(F.col("mapped").isNotNull(), link("mapped")).otherwise(F.col("part"))
    rows = parts.withColumn("part", new).groupBy("title", "pos", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("value"))
    line = F.format_string("| %s = %s", "name", "value")
    out = rows.withColumn("line", line).groupBy("title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return out.select("title", F.concat(F.lit("{{Navbox\n"), "lines", F.lit("\n}}")).alias("content"))


def template_pages(docs: DataFrame, labels: list[tuple[str, str]] = LABELS) -> DataFrame:
    """(title, content, template_data): templates (title, text) with their parameters renamed, old names as fallbacks, a documentation tail, and TemplateData as JSON."""
    names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("\\{\\{\\{([^{}|]+)"), F.lit(1)), lambda x: F.trim(x))))
    body = T.rewrite("text", [(f"\\{{\\{{\\{{{a}\\|", f"{{{{{{{b}|{{{{{{{a}|}}}}}}|") for a, b in labels if a != b] + [("(?s)<noinclude>.*?</noinclude>", "")])
    data = F.to_json(F.struct(F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.struct(F.coalesce(*(F.when(n == a, F.lit(b)) for a, b in labels), n).alias("label"), F.lit("string").alias("type"))))).alias("params")))
    return docs.select(W.title_in("title").alias("title"), F.concat(F.rtrim(body), F.lit("<noinclude>\n{{Dokumentasi}}\n</noinclude>")).alias("content"), data.alias("template_data"))


# categories -------------------------------------------------------------------------------


def category_drafts(wanted: DataFrame, parents: DataFrame, existing: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(title, content, status): category pages to be made.  wanted: (category, title); parents: (category, parent); existing and overrides: (title) and (category, parent).  A target that exists or a category without parents is refused."""
    own = parents if overrides is None else parents.join(overrides.select("category").distinct(), "category", "left_anti").unionByName(overrides)
    lines = own.groupBy("category").agg(F.array_sort(F.collect_set(F.format_string("[[Kategori:%s]]", "parent"))).alias("lines"))
    rows = wanted.join(lines, "category", "left").join(existing.select("title", F.lit(True).alias("there")).distinct(), "title", "left")
    status = F.when(F.col("there"), "target exists").when(F.col("lines").isNull(), "no parents").otherwise("ready")
    return rows.select("title", F.array_join("lines", "\n").alias("content"), status.alias("status"))


def replicated_categories(explicit: DataFrame, rendered: DataFrame, mapping: DataFrame) -> DataFrame:
    """(title, category, mapped, origin): categories in the text and, where the text lacks them, those that templates add; mapping: (category, mapped)."""
    both = explicit.withColumn("p", F.lit(0)).unionByName(rendered.withColumn("p", F.lit(1)))
    once = both.groupBy("title", "category").agg(F.min("p").alias("p")).join(mapping, "category", "left")
    return once.select("title", "category", "mapped", F.when(F.col("p") == 0, "explicit").otherwise("rendered").alias("origin"))


def resolved_categories(names: DataFrame, cache: DataFrame, langlinks: DataFrame, existing: DataFrame, rules: list[tuple[str, str]], sitelinks: DataFrame) -> DataFrame:
    """(category, mapped, origin): cache, then the language link, then the rules, then variations of the rule's result, then the site link; all but the cache have to exist; else the name itself."""
    there = existing.select(F.col("title").alias("_t"), F.lit(True).alias("_ok")).distinct()

    def checked(df: DataFrame, value: Column, name: str) -> DataFrame:
        out = df.withColumn(f"_{name}v", value).join(there, F.col(f"_{name}v") == F.col("_t"), "left")
        return out.withColumn(name, F.when(F.col("_ok"), F.col(f"_{name}v"))).drop("_t", "_ok", f"_{name}v")

    rows = names.select("category").distinct().join(cache.select("category", F.col("mapped").alias("cache")), "category", "left").join(langlinks.select("category", F.col("mapped").alias("_l")), "category", "left").join(sitelinks.select("category", F.col("mapped").alias("_s")), "category", "left")
    rule = T.rewrite("category", rules)
    rows = checked(rows, F.col("_l"), "langlink")
    rows = checked(rows, F.when(rule != F.col("category"), rule), "rule")
    rows = checked(rows, F.regexp_replace(rule, " tahun ", " "), "variation")
    rows = checked(rows, F.col("_s"), "sitelink")
    steps = ("cache", "langlink", "rule", "variation", "sitelink")
    origin = F.coalesce(*(F.when(F.col(s).isNotNull(), s) for s in steps), F.lit("unresolved"))
    return rows.select("category", F.coalesce(*steps, "category").alias("mapped"), origin.alias("origin"))


# evidence, letters, snapshots -------------------------------------------------------------


def evidence(names: DataFrame, sources: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(name, mapped, source, confidence): each name's evidence, the most trusted source first; sources: (label, table of (name, mapped), confidence)."""
    rows = [t.select("name", "mapped", F.lit(k).alias("source"), F.lit(c).alias("confidence"), F.lit(i).alias("p")) for i, (k, t, c) in enumerate(sources)]
    found = rows[0]
    for r in rows[1:]:
        found = found.union(r)
    best = found.groupBy("name").agg(F.min_by(F.struct("mapped", "source", "confidence"), F.struct("p", "mapped")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", "b.mapped", F.coalesce("b.source", F.lit("none")).alias("source"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def review_letter(reviews: DataFrame) -> DataFrame:
    """(draft_id, content): a review (draft_id, score, verdict, n_fatal, n_calques, n_typos, n_reference_issues) as a letter."""
    parts = [F.format_string("== Tinjauan %s ==", F.col("draft_id").cast("string")), F.format_string("Skor: %d (%s)", F.col("score").cast("int"), "verdict")]
    for name, label in (("n_fatal", "Kesalahan fatal"), ("n_calques", "Kalkir"), ("n_typos", "Ejaan"), ("n_reference_issues", "Rujukan")):
        parts.append(F.when(F.col(name) > 0, F.format_string(f"* {label}: %d", F.col(name).cast("int"))))
    return reviews.select("draft_id", F.concat_ws("\n", *parts).alias("content"))


def rationale(files: DataFrame) -> DataFrame:
    """(file, content): the fair-use rationale of a file (file, article, source, author)."""
    return files.select("file", F.format_string("== Ringkasan ==\n{{Alasan penggunaan wajar\n| artikel = %s\n| sumber = %s\n| pencipta = %s\n| resolusi = rendah\n}}", "article", F.coalesce("source", F.lit("-")), F.coalesce("author", F.lit("-"))).alias("content"))


def prompt_glossary(sources: list[DataFrame], exemplars: DataFrame, most: int = 2) -> DataFrame:
    """(topic, content): glossary lines of a topic, later sources (topic, term, target) overriding earlier ones, sorted, and at most `most` exemplars (topic, text)."""
    rows = None
    for i, s in enumerate(sources):
        r = s.select("topic", "term", "target", F.lit(i).alias("p"))
        rows = r if rows is None else rows.union(r)
    last = rows.groupBy("topic", "term").agg(F.max_by("target", F.struct("p", "target")).alias("target"))
    lines = last.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s = %s", "term", "target"))), "\n").alias("g"))
    few = exemplars.groupBy("topic").agg(F.array_join(F.slice(F.array_sort(F.collect_set("text")), 1, most), "\n---\n").alias("x"))
    return lines.join(few, "topic", "left").select("topic", F.concat_ws("\n\n", "g", "x").alias("content"))


def promotion(results: DataFrame) -> DataFrame:
    """(title, promoted, reason) of test pages (title, html): an error, a Lua error, a missing template or unclosed markup in what was rendered holds a page back."""
    h = F.coalesce("html", F.lit(""))
    reason = F.when(h == "", "nothing rendered").when(h.rlike("(?i)lua error"), "Lua error").when(h.rlike("class=\"[^\"]*\\berror\\b"), "error").when(h.rlike("class=\"new\"[^>]*>(?:Templat|Template):"), "missing template").when(F.size(rewrites.syntax_issues(h)) > 0, "unclosed markup")
    return results.select("title", reason.isNull().alias("promoted"), reason.alias("reason"))


def ecosystem_sync(order: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, node, status): nodes in order (place, node); promoted if their test page passed and everything that they need, near or far, was promoted, else failed or blocked.  edges: src needs dst."""
    from .graph import deployment

    passed = promotion(tests).select(F.col("title").alias("node"), "promoted")
    rows = order.join(passed, "node", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))
    failed = rows.filter("NOT promoted").select("node")
    blocked = deployment(edges, order.select("node"), failed).filter("status = 'blocked'").select("node", F.lit(True).alias("b"))
    status = F.when(~F.col("promoted"), "failed").when(F.col("b"), "blocked").otherwise("promoted")
    return rows.join(blocked, "node", "left").select("place", "node", status.alias("status"))


def snapshot(drafts: DataFrame, run: str) -> DataFrame:
    """(run, title, content_sha256, n_chars, candidates): what a run puts up for approval; drafts: (title, content)."""
    return drafts.select(F.lit(run).alias("run"), "title", F.sha2("content", 256).alias("content_sha256"), F.length("content").alias("n_chars"), F.transform(F.slice(F.array_sort(W.candidates("content")), 1, 20), lambda x: x["term"]).alias("candidates"))


def session_report(log: DataFrame) -> DataFrame:
    """(article, category, n, items): records of a session (article, category, item, ts) by category, each item once, in order of its first time."""
    once = log.groupBy("article", "category", "item").agg(F.min("ts").alias("ts"))
    return once.groupBy("article", "category").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "item"))), lambda x: x["item"]).alias("items"))


def write_plan(kind: str, rows: DataFrame, target: Column, content: Column) -> DataFrame:
    """(kind, target, content, content_sha256): edits, moves, uploads or links as rows of a plan; none is carried out."""
    return rows.select(F.lit(kind).alias("kind"), target.alias("target"), content.alias("content"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("content_sha256"))


# dictionary -------------------------------------------------------------------------------


def dictionary_entries(lemmas: DataFrame, snapshot_: DataFrame) -> DataFrame:
    """(lemma, kind, definition, synonyms, found): entries (lemma, json) of a dictionary, whatever shape their definitions and synonyms have."""
    rows = lemmas.select("lemma").distinct().join(snapshot_, "lemma", "left")
    definition = F.coalesce(F.get_json_object("json", "$.definition[0].text"), F.get_json_object("json", "$.definition[0]"), F.get_json_object("json", "$.definition"))
    syn = F.coalesce(F.from_json(F.get_json_object("json", "$.synonyms"), "array<string>"), F.split(F.get_json_object("json", "$.synonyms"), " *[,;] *"), F.array().cast("array<string>"))
    return rows.select("lemma", F.get_json_object("json", "$.class").alias("kind"), definition.alias("definition"), F.array_sort(F.array_distinct(F.filter(syn, lambda x: x.isNotNull() & (x != "")))).alias("synonyms"), F.col("json").isNotNull().alias("found"))


def reverse_search(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(word, lemma): lemmas (lemma, definition) in whose definition a word (word) stands; a join on words, not on text."""
    by = entries.select("lemma", F.explode(F.array_distinct(T.words(F.lower("definition")))).alias("word"))
    return words.select(F.lower("word").alias("word")).distinct().join(by, "word").select("word", "lemma")


def knowledge_search(knowledge: DataFrame, part: str) -> DataFrame:
    """Rows of a knowledge table (topic, term, value) whose term or value holds `part`, whatever its case."""
    low = part.lower()
    return knowledge.filter(F.contains(F.lower("term"), F.lit(low)) | F.contains(F.lower("value"), F.lit(low)))


def for_topic(memory: DataFrame, topic: str | None) -> DataFrame:
    """Rows of a topic and those of none, the most used first, then the latest, then by term."""
    own = memory.filter(F.col("topic").isNull() | F.col("topic").eqNullSafe(F.lit(topic)))
    return own.orderBy(F.desc("usage_count"), F.desc("updated_at"), "term")


def without_topic(memory: DataFrame, topic: str) -> DataFrame:
    """The table after all rows of a topic are deleted."""
    return memory.filter(~F.col("topic").eqNullSafe(F.lit(topic)))


def ranked_options(mentions: DataFrame, options: DataFrame, least: float = 2.0) -> DataFrame:
    """(title, option, score): for mentions (title, context) of an ambiguous title, the option (title, option, description) that shares most words with the context, where it is strong and has no equal."""
    words = lambda c: F.array_distinct(F.filter(T.words(F.lower(c)), lambda w: F.length(w) > 3))
    a = mentions.select("title", F.explode(words("context")).alias("w")).distinct()
    b = options.select("title", "option", F.explode(words(F.concat_ws(" ", "option", "description"))).alias("w"))
    scores = a.join(b, ["title", "w"]).groupBy("title", "option").agg(F.count("*").cast("double").alias("score"))
    top = scores.groupBy("title").agg(F.max("score").alias("score"))
    best = scores.join(top, ["title", "score"]).groupBy("title", "score").agg(F.count("*").alias("n"), F.min("option").alias("option"))
    return best.filter((F.col("n") == 1) & (F.col("score") >= least)).select("title", "option", "score")


def subsets(sets: DataFrame, others: DataFrame) -> DataFrame:
    """(key, other): sets (key, items) all of whose items are in another one (key as other, items); they meet on one item."""
    a = sets.filter("size(items) > 0").select("key", "items", F.array_min("items").alias("i"))
    b = others.select(F.col("key").alias("other"), F.col("items").alias("all"), F.explode(F.array_distinct("items")).alias("i"))
    return a.join(b, "i").filter(F.size(F.array_except("items", "all")) == 0).select("key", "other")


# mining -----------------------------------------------------------------------------------


def _either(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", "\\s+") for w in words) + ")"


def cued(said: Column, cues: list[str]) -> Column:
    """Whether one of the last CUE_GAP + 1 words, whatever its affixes, has the stem of a cue."""
    tail = T.words(F.lower(said))
    tail = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - CUE_GAP), CUE_GAP + 1)
    return F.exists(tail, lambda w: reduce(lambda a, b: a | b, (F.contains(w, F.lit(c)) for c in cues)))


def quotations(text: Column) -> Column:
    """(before, phrase): quoted phrases of TERM_LETTERS letters, each with the words of its clause before it; any kind of quotation mark will do."""
    parts = F.split(F.regexp_replace(text, "[“”„‘’']", '"'), '"')
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int") - 1)), lambda k: F.struct(F.element_at(F.split(F.get(parts, k * 2), "[.!?\n]"), -1).alias("before"), F.trim(F.coalesce(F.get(parts, k * 2 + 1), F.lit(""))).alias("phrase")))
    return F.filter(pairs, lambda x: (F.size(parts) > 2) & F.length(x["phrase"]).between(*TERM_LETTERS) & x["phrase"].rlike("^[\\p{L} -]+$"))


def thread_terms(threads: DataFrame, cues: dict[str, list[str]] = CUES) -> DataFrame:
    """(thread_id, term, target, topic, family): terms that discussions (thread_id, title, text) recommend: a link to the other wiki and the link it becomes, quotations that a cue puts forward under a title that names a term, and 'A vs B' titles.  Null texts have none."""
    t, title = F.coalesce("text", F.lit("")), F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "^=+ *| *=+$", ""))
    # links and what stands between them: a foreign link, a cue, and the next link
    links = F.split(t, "\\[\\[")
    name = lambda x: F.trim(F.substring_index(F.substring_index(F.substring_index(x, "]]", 1), "|", 1), "#", 1))
    after = lambda x: F.substring_index(x, "]]", -1)
    near = lambda x: (F.size(T.words(after(x))) <= CUE_GAP + 1) & cued(after(x), cues["becomes"])
    turned = F.transform(links, lambda x, k: F.when(F.startswith(F.lower(x), F.lit(":en:")) & near(x) & F.get(links, k + 1).isNotNull(), F.struct(F.lower(F.regexp_replace(name(x), "(?i)^:en:", "")).alias("term"), name(F.get(links, k + 1)).alias("target"), F.lit("link").alias("family"))))
    # the term of a title is what it quotes, or the title itself where that is a plain phrase
    in_title = F.get(quotations(title), F.lit(0))["phrase"]
    named = F.lower(F.coalesce(in_title, F.when(title.rlike("^[A-Za-z -]{3,35}$") & ~title.rlike(f"(?i){NOISE}"), title)))
    said = F.filter(quotations(t), lambda x: cued(x["before"], cues["proposes"]))
    proposed = F.transform(F.when(named.isNotNull(), said).otherwise(F.slice(said, 1, 0)), lambda x: F.struct(named.alias("term"), x["phrase"].alias("target"), F.lit("proposal").alias("family")))
    # of two forms in a title the one that the text has is the standard one, where the text speaks of a standard
    sides = F.transform(F.split(title, "(?i)\\bvs\\b\\.?"), lambda x: F.trim(x))
    pick = lambda i, j: F.when(F.contains(F.lower(t), F.lower(sides[j])), F.struct(F.lower(sides[i]).alias("term"), sides[j].alias("target"), F.lit("versus").alias("family")))
    versus = F.array(F.when((F.size(sides) == 2) & F.contains(F.lower(t), F.lit("baku")), F.coalesce(pick(0, 1), pick(1, 0))))
    found = F.filter(F.concat(turned, proposed, versus), lambda x: x.isNotNull())
    rows = threads.select("thread_id", W.topic(F.concat_ws(" ", "title", "text")).alias("topic"), F.explode(found).alias("x"))
    return rows.select("thread_id", "x.term", "x.target", "topic", "x.family").filter("length(term) > 2 AND length(target) > 2 AND term <> lower(target)").distinct()


def critiques(reviews: DataFrame) -> DataFrame:
    """(review_id, quote, critique, kind) of list items that quote a draft and remark on it, in reviews (review_id, text); done marks and short remarks are left out."""
    items = F.filter(F.transform(F.split(F.regexp_replace("text", "[“”„]", '"'), "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[*:]+ *[\"'].*[\"']"))
    rows = reviews.select("review_id", F.explode(items).alias("item")).withColumn("item", F.regexp_replace("item", "^[*: ]+|<!--.*?-->", ""))
    quote = F.regexp_extract("item", "^([\"'])(.*?)\\1", 2)
    said = F.trim(F.regexp_replace(F.col("item").substr(F.length(quote) + 3, F.length("item")), "^[ =>:–-]+", ""))
    out = rows.select("review_id", F.trim(quote).alias("quote"), said.alias("critique")).filter(F.length("quote").between(*QUOTE_LETTERS) & (F.length("critique") > LEAST_REMARK)).filter(~F.col("critique").rlike("^\\{\\{(?:done|sudah)"))
    kind = F.coalesce(*(F.when(F.lower("critique").rlike(_either(words)), name) for name, words in REMARKS), F.lit("style"))
    return out.select("review_id", "quote", "critique", kind.alias("kind"))


def exported_lexicon(terms: DataFrame, obsolete: list[str] = ()) -> DataFrame:
    """(topic, term, target): recommended terms (topic, term, target, year, status) without talk, function words and obsolete ones; of each term in a topic the latest."""
    low = F.lower("target")
    ok = (F.col("status") == "recommended") & ~F.lower("term").rlike(NOISE) & ~low.isin(*FUNCTION_WORDS, *obsolete) & (F.length("term") >= 3) & (F.length("target") >= 3) & (F.lower("term") != low)
    rows = terms.filter(ok).select(F.coalesce("topic", F.lit("general")).alias("topic"), F.lower(F.trim("term")).alias("term"), F.trim("target").alias("target"), F.coalesce("year", F.lit(0)).alias("year"))
    return rows.groupBy("topic", "term").agg(F.max_by("target", F.struct("year", "target")).alias("target"))


def archive_pages(archives: DataFrame, first: int, last: int) -> DataFrame:
    """(title, year): archive titles (pattern with %d) for each year, each once."""
    years = archives.select("pattern", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return keep_first(years.select(F.format_string("%s%d", F.regexp_replace("pattern", "%d$", ""), "year").alias("title"), "year"), F.col("title"), F.col("year"))


def translated(sections: DataFrame, translate: Callable[[pd.Series], pd.Series], text: str = "content") -> DataFrame:
    """`sections` with draft: the hook for a translator, called on Arrow batches of texts; it may return null where it refuses one."""

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return translate(texts)

    return sections.withColumn("draft", run(text))


def cached_entries(lemmas: DataFrame, cache: DataFrame, live: DataFrame, now: Column, ttl: str = "INTERVAL 30 DAYS") -> DataFrame:
    """(lemma, json, origin): a fresh cache row (lemma, json, updated_at), else the live answer (lemma, json), else the stale row, else nothing."""
    c = cache.select("lemma", F.col("json").alias("_c"), (F.col("updated_at") > now - F.expr(ttl)).alias("_fresh"))
    rows = lemmas.select("lemma").distinct().join(c, "lemma", "left").join(live.select("lemma", F.col("json").alias("_l")), "lemma", "left")
    origin = F.when(F.col("_fresh"), "fresh").when(F.col("_l").isNotNull(), "live").when(F.col("_c").isNotNull(), "stale").otherwise("none")
    return rows.select("lemma", F.when(F.col("_fresh"), F.col("_c")).otherwise(F.coalesce("_l", "_c")).alias("json"), origin.alias("origin"))


def case_kept_fixes(text, fixes: list[tuple[str, str]]) -> Column:
    """Words replaced in the case they stand in, longest first, between markup."""
    rules = rewrites.any_case(sorted(fixes, key=lambda x: (-len(x[0]), x[0])))
    return rewrites.between(T.col(text), rewrites.KEPT, lambda p: T.rewrite(p, rules))
