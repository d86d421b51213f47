"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, graph, localise, ordered, resolve
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# shared SQL pieces ------------------------------------------------------------------------

_W = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
_PROPER = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*"
_NUMBER = "[0-9]+(?:[.,][0-9]+)*"


def _words(x: str) -> str:
    return _W.format(x)


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_PAIRS = "(SELECT * FROM (SELECT lag(doc_id) OVER w AS source_id, doc_id AS draft_id, lag(text) OVER w AS source_text, text AS draft_text FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE source_id IS NOT NULL)"
_PENALTY = " + ".join(f"{audits.PENALTY[r.severity]} * {_n('text', r.pattern)}" for r in audits.RULES)
_COUNT = " + ".join(_n("text", r.pattern) for r in audits.RULES)
_SENT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([0-9])\.([0-9])', '\1․\2', 'g'), '[.!?]+(?:\s+|$)', '\0␞', 'g'), '␞'),
    lambda s: trim(translate(translate(s, chr(10), ' '), '․', '.'))), lambda s: len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')) >= 3)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return audits.pairs_in_order(_docs(spark, d))


# texts ------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, ({_COUNT})::INT AS n_violations, greatest(0, least(100, 100 - ({_PENALTY})))::INT AS score,
    CASE WHEN greatest(0, 100 - ({_PENALTY})) >= 90 THEN 'clean' WHEN greatest(0, 100 - ({_PENALTY})) >= 70 THEN 'minor'
         WHEN greatest(0, 100 - ({_PENALTY})) >= 40 THEN 'review' ELSE 'rewrite' END AS verdict FROM documents""")
def lint_score(spark, d):
    return audits.lint_score(_docs(spark, d))


@query(" UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, '{r.severity}' AS severity, {_n('text', r.pattern)}::INT AS n FROM documents WHERE {_n('text', r.pattern)} > 0" for r in audits.RULES))
def lint_violations(spark, d):
    return audits.violations(_docs(spark, d))


@query(rf"""WITH x AS (SELECT doc_id, len({_words('text')}) w, {_n('text', '[.!?]+')} s, {_n('text', '[#$%&*]{3,}')} sym, {_n('text', '[!?]{2,}')} rep, {_n('text', r'@[A-Za-z0-9.]+\.[a-z]{2,}')} mail FROM documents),
    y AS (SELECT doc_id, greatest(0, 100 - (CASE WHEN w < 50 THEN 40 ELSE 0 END + CASE WHEN s * 60 < w THEN 20 ELSE 0 END)) AS draft,
      greatest(0, 100 - (least(60, sym * 5) + least(30, rep * 2))) AS language, greatest(0, 100 - least(50, mail * 25)) AS technique, mail > 0 AS critical FROM x),
    z AS (SELECT *, CASE WHEN critical THEN least(65, (draft * 25 + language * 45 + technique * 30) // 100) ELSE (draft * 25 + language * 45 + technique * 30) // 100 END AS total FROM y)
    SELECT doc_id, draft::INT AS draft, language::INT AS language, technique::INT AS technique, critical, total::INT AS total,
      CASE WHEN total >= 95 THEN 'A++' WHEN total >= 90 THEN 'A+' WHEN total >= 85 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' ELSE 'F' END AS grade,
      total >= 80 AND NOT critical AS approved FROM z""")
def qa_grade(spark, d):
    return audits.qa_grade(_docs(spark, d))


@query(f"""SELECT doc_id, len({_words('text')})::INT AS n_words, length(text)::INT AS n_characters, len(string_split(text, chr(10)))::INT AS n_lines,
    {_n('text', '[.!?]+')}::INT AS n_ends, len(list_distinct({_words('lower(text)')}))::INT AS n_distinct FROM documents""")
def doc_stats(spark, d):
    return audits.doc_stats(_docs(spark, d))


@query(f"""WITH x AS (SELECT doc_id, len({_words('text')}) w, greatest(1, {_n('text', '[.!?]+')}) s, {_n('text', _NUMBER)} d FROM documents)
    SELECT doc_id, CASE WHEN w < 60 THEN 'low' WHEN d >= 10 THEN 'high' WHEN w > 25 * s THEN 'high' WHEN w > 400 THEN 'medium' ELSE 'low' END AS tier FROM x""")
def complexity_tier(spark, d):
    return audits.complexity_tier(_docs(spark, d))


@query("SELECT source, sum(greatest(1, round_even(length(text) / 3.8, 0)::INT))::BIGINT AS tokens, count(*) AS n_docs FROM documents GROUP BY source")
def token_estimate(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(T.estimate_tokens("text")).alias("tokens"), F.count("*").alias("n_docs"))


_KEY = r"lower(trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g')))"


@query(f"SELECT doc_id, sha256(concat_ws('|', {_KEY.format('text')}, lang, source)) AS content_key FROM documents")
def content_key(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.concat_ws("|", T.key("text"), "lang", "source"), 256).alias("content_key"))


@query(f"""WITH k AS (SELECT doc_id, sha256({_KEY.format('text')}) AS content_key FROM documents)
    SELECT * FROM k WHERE content_key NOT IN (SELECT content_key FROM k JOIN labels USING (doc_id))""")
def cache_miss(spark, d):
    """Documents whose text is not among the labelled ones: the cache holds those."""
    k = _docs(spark, d).select("doc_id", F.sha2(T.key("text"), 256).alias("content_key"))
    cached = k.join(table(spark, d, "labels"), "doc_id", "left_semi").select("content_key").distinct()
    return resolve.missing(k, cached, "content_key").select("doc_id", "content_key")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {_KEY.format('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, d):
    k = _docs(spark, d).select("doc_id", "source", F.sha2(T.key("text"), 256).alias("k"))
    return ordered.keep_first(k, F.col("k"), F.col("doc_id")).select("doc_id", "source")


@query(f"SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBER}')) AS number FROM documents) GROUP BY ALL")
def number_mentions(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.matches("text", T.NUMBER)).alias("number")).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT * FROM {_PAIRS}),
    a AS (SELECT source_id, draft_id, number, count(*) a FROM (SELECT source_id, draft_id, unnest(regexp_extract_all(source_text, '{_NUMBER}')) AS number FROM p) GROUP BY ALL),
    b AS (SELECT source_id, draft_id, number, count(*) b FROM (SELECT source_id, draft_id, unnest(regexp_extract_all(draft_text, '{_NUMBER}')) AS number FROM p) GROUP BY ALL)
    SELECT source_id, draft_id, number, a - coalesce(b, 0) AS missing FROM a LEFT JOIN b USING (source_id, draft_id, number) WHERE a - coalesce(b, 0) > 0""")
def number_except_all(spark, d):
    return audits.missing_numbers(_pairs(spark, d))


@query(f"""WITH p AS (SELECT * FROM {_PAIRS}),
    a AS (SELECT source_id, draft_id, w, count(*) a FROM (SELECT source_id, draft_id, unnest({_words('lower(source_text)')}) AS w FROM p) GROUP BY ALL),
    b AS (SELECT source_id, draft_id, w, count(*) b FROM (SELECT source_id, draft_id, unnest({_words('lower(draft_text)')}) AS w FROM p) GROUP BY ALL)
    SELECT source_id, draft_id, sum(a)::BIGINT AS n_source, sum(least(a, coalesce(b, 0)))::BIGINT AS n_kept, sum(least(a, coalesce(b, 0))) >= sum(a) * 0.6::DOUBLE AS passed
    FROM a LEFT JOIN b USING (source_id, draft_id, w) GROUP BY ALL""")
def lexical_retention(spark, d):
    return audits.lexical_retention(_pairs(spark, d))


@query(f"""WITH p AS (SELECT source_id, draft_id, len({_SENT.format('source_text')}) n, len({_SENT.format('draft_text')}) m FROM {_PAIRS}),
    x AS (SELECT source_id, draft_id, n, m, unnest(range(n)) AS i FROM p WHERE n > 0 AND m > 0)
    SELECT source_id, draft_id, i::INT AS i, least(round_even(i * m / n, 0)::INT, m - 1)::INT AS j FROM x""")
def aligned_sentences(spark, d):
    return audits.aligned_sentences(_pairs(spark, d))


@query(f"SELECT doc_id, len(s)::INT AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::INT AS longest FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents)")
def sentence_stats(spark, d):
    s = T.sentences("text")
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query(f"""WITH p AS (SELECT * FROM {_PAIRS}),
    a AS (SELECT source_id, draft_id, number, count(*) a FROM (SELECT source_id, draft_id, unnest(regexp_extract_all(source_text, '[0-9]{{3,}}')) AS number FROM p) GROUP BY ALL),
    b AS (SELECT source_id, draft_id, number, count(*) b FROM (SELECT source_id, draft_id, unnest(regexp_extract_all(draft_text, '[0-9]{{3,}}')) AS number FROM p) GROUP BY ALL),
    l AS (SELECT source_id, draft_id, sum(greatest(a - coalesce(b, 0), 0)) AS lost FROM a LEFT JOIN b USING (source_id, draft_id, number) GROUP BY ALL),
    c AS (SELECT source_id, draft_id, len({_words('source_text')}) a, len({_words('draft_text')}) b FROM p)
    SELECT source_id, draft_id, CASE WHEN b = 0 THEN 'empty' WHEN b * 100 < a * 15 THEN 'short' WHEN coalesce(lost, 0) >= 4 THEN 'numbers' ELSE 'ok' END AS reason
    FROM c LEFT JOIN l USING (source_id, draft_id)""")
def section_gate(spark, d):
    return audits.section_gate(_pairs(spark, d))


@query(rf"""SELECT source_id, draft_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS dropped, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS phantom FROM
    (SELECT source_id, draft_id, list_distinct(regexp_extract_all(source_text, '{_PROPER}')) AS a, list_distinct(regexp_extract_all(draft_text, '{_PROPER}')) AS b FROM {_PAIRS})""")
def entity_grounding(spark, d):
    return audits.entity_grounding(_pairs(spark, d))


_TERMS = rf"(SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_PROPER}')) AS term FROM documents) GROUP BY ALL)"


@query(f"""SELECT doc_id, term, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(string_split(term, ' ')) DESC, length(term) DESC, term COLLATE "C") AS rank FROM {_TERMS}) WHERE rank <= 10""")
def candidate_terms(spark, d):
    return resolve.candidate_terms(_docs(spark, d))


@query(f"""WITH t AS (SELECT doc_id, term FROM {_TERMS})
    SELECT doc_id, term FROM t WHERE NOT EXISTS (SELECT 1 FROM t AS u WHERE u.doc_id = t.doc_id AND u.term <> t.term AND contains(' ' || u.term || ' ', ' ' || t.term || ' '))""")
def substring_elimination(spark, d):
    # three ways lead to the terms below, so they are taken from the texts once
    terms = graph.cut(_docs(spark, d).select("doc_id", F.explode(F.array_distinct(T.matches("text", T.PROPER))).alias("term")))
    return resolve.longest_only(terms)


_GLOSS = rf"""(SELECT lower(term) AS term, lang AS target, CASE WHEN lang = 'en' THEN 'base' WHEN lang = 'fr' THEN 'cache' WHEN lang = 'de' THEN 'custom' ELSE 'topic' END AS source
    FROM (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '{_PROPER}')) AS term FROM documents))"""


def _glossary(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised phrases with the languages that they occur in as targets, each language as a source of its own."""
    t = _docs(spark, d).select("lang", F.explode(T.matches("text", T.PROPER)).alias("term")).distinct()
    source = F.when(F.col("lang") == "en", "base").when(F.col("lang") == "fr", "cache").when(F.col("lang") == "de", "custom").otherwise("topic")
    return t.select(F.lower("term").alias("term"), F.col("lang").alias("target"), source.alias("source")).distinct()


def _priority_sql(order: tuple[str, ...]) -> str:
    case = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order))
    return f"""WITH g AS {_GLOSS}, r AS (SELECT term, target, source, row_number() OVER (PARTITION BY term ORDER BY CASE source {case} END, target) AS k FROM g)
        SELECT term, target, source AS origin FROM r WHERE k = 1"""


@query(_priority_sql(resolve.TERM_ORDER))
def glossary_priority(spark, d):
    g = _glossary(spark, d)
    return resolve.first_match(g.select("term").distinct(), g, resolve.TERM_ORDER)


@query(_priority_sql(resolve.SECTION_ORDER))
def glossary_section_priority(spark, d):
    g = _glossary(spark, d)
    return resolve.first_match(g.select("term").distinct(), g, resolve.SECTION_ORDER)


@query(f"SELECT term, min(target) AS target FROM {_GLOSS} GROUP BY term HAVING count(DISTINCT target) = 1")
def unambiguous_terms(spark, d):
    return resolve.unambiguous(_glossary(spark, d), "term", "target")


_GLOSSARY_WORDS = [("the", "la"), ("and", "et"), ("of", "de"), ("in", "en"), ("with", "avec"), ("or", "und")]


@query(f"""WITH g(term, target) AS (VALUES {', '.join(str(x) for x in _GLOSSARY_WORDS)}), p AS (SELECT * FROM {_PAIRS}),
    a AS (SELECT DISTINCT source_id, draft_id, unnest({_words('lower(source_text)')}) AS term FROM p), b AS (SELECT DISTINCT source_id, draft_id, unnest({_words('lower(draft_text)')}) AS target FROM p)
    SELECT source_id, draft_id, term, target FROM a JOIN g USING (term) ANTI JOIN b USING (source_id, draft_id, target)""")
def glossary_consistency(spark, d):
    g = spark.createDataFrame(_GLOSSARY_WORDS, "term string, target string")
    return resolve.glossary_consistency(_pairs(spark, d), F.broadcast(g))  # a fixed handful of rows


_PHRASES = ["of the", "in the", "is the", "de la", "mit der", "the"]


@query(f"""WITH w AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents), g AS (
    SELECT doc_id, unnest(w) AS phrase FROM w
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
    SELECT doc_id, phrase, count(*) AS n FROM g WHERE phrase IN ({', '.join(repr(p) for p in _PHRASES)}) GROUP BY ALL""")
def phrase_mentions(spark, d):
    return resolve.phrase_mentions(_docs(spark, d), spark.createDataFrame([(p,) for p in _PHRASES], "phrase string"), most=2)


#: Ordered rewrites: ranges, quotes, stray spaces, repeated marks, spelled-out symbols.
REWRITES = [("([0-9])-([0-9])", "$1–$2"), ("[“”]", '"'), ("[‘’]", "'"), (" +([,;:.!?])", "$1"), ("([!?])[!?]+", "$1"), (",{2,}", ","), ("  +", " ")]


def _rewritten(x: str, rules: list[tuple[str, str]] = REWRITES) -> str:
    """The SQL of ordered rewrites; Java writes groups as $1 and a dollar sign as \\$."""
    for a, b in rules:
        b = b.replace("\\$", "\0")
        for k in "123":
            b = b.replace(f"${k}", f"\\{k}")
        b = b.replace("\0", "$")
        x = f"regexp_replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


@query(f"SELECT doc_id, sha256({_rewritten('text')}) AS text_sha256, {_rewritten('text')} <> text AS changed FROM documents")
def typography_rewrites(spark, d):
    t = T.rewrite("text", REWRITES)
    return _docs(spark, d).select("doc_id", F.sha2(t, 256).alias("text_sha256"), (t != F.col("text")).alias("changed"))


@query(r"""SELECT doc_id, lang, CASE WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'ru' WHEN regexp_matches(text, '\p{Han}') THEN 'zh' WHEN regexp_matches(text, '[ßäöü]') THEN 'de'
    WHEN regexp_matches(text, '[ñáíóú]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS guessed FROM documents""")
def language_context(spark, d):
    return _docs(spark, d).select("doc_id", "lang", T.script_language("text").alias("guessed"))


# relations --------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 9000 THEN 'direct' WHEN n_name IS NOT NULL THEN n_name ELSE r_name END AS resolved,
    CASE WHEN c_acctbal > 9000 THEN 'known' WHEN n_name IS NOT NULL THEN 'nation' WHEN r_name IS NOT NULL THEN 'region' ELSE 'unresolved' END AS origin
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 LEFT JOIN (SELECT n_nationkey AS k, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON k = c_nationkey""")
def resolve_fallback(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    known = c.filter("c_acctbal > 9000").select("c_custkey", F.lit("direct").alias("v"))
    base = c.select("c_custkey", "c_nationkey").join(known, "c_custkey", "left").withColumnRenamed("v", "_known0")
    nation = n.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    region = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    out = resolve.fallback(base, [("nation", nation, "n_name"), ("region", region, "r_name")], "c_nationkey")
    hit = F.col("_known0").isNotNull()
    return out.select("c_custkey", "c_nationkey", F.when(hit, F.col("_known0")).otherwise(F.col("resolved")).alias("resolved"), F.when(hit, "known").otherwise(F.col("origin")).alias("origin"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_targets(spark, d):
    return resolve.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_targets(spark, d):
    return resolve.present(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem WHERE l_returnflag = 'A')
    SELECT coalesce(a.g, b.g) AS l_suppkey, count(*) FILTER (WHERE a.g IS NOT NULL AND b.g IS NOT NULL) AS existing, count(*) FILTER (WHERE b.g IS NULL) AS missing, count(*) FILTER (WHERE a.g IS NULL) AS extra
    FROM a FULL JOIN b ON a.g = b.g AND a.m = b.m GROUP BY 1""")
def category_diff(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return resolve.set_diff(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'A'"), "l_suppkey", "l_partkey")


@query("""SELECT p_brand, count(*) AS n_members, count(DISTINCT p_type) AS n_kinds, count(*) >= 30 AND count(DISTINCT p_type) >= 2 AS create_it FROM part GROUP BY p_brand""")
def category_curation(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n_members"), F.countDistinct("p_type").alias("n_kinds"))
    return g.withColumn("create_it", (F.col("n_members") >= 30) & (F.col("n_kinds") >= 2))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F') AS failed,
    sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice)::BIGINT ELSE 0 END)::BIGINT AS saved FROM orders GROUP BY o_orderpriority""")
def batch_report(spark, d):
    ok = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~ok, 1)).alias("failed"), F.sum(F.when(ok, F.floor("o_totalprice")).otherwise(0)).alias("saved"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Region to nation to supplier and customer."""
    n, s, c = (table(spark, d, x) for x in ("nation", "supplier", "customer"))
    node = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
    e = n.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    e = e.union(s.select(node("n", "s_nationkey"), node("s", "s_suppkey")))
    return e.union(c.select(node("n", "c_nationkey"), node("c", "c_custkey")))


_EDGES = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t(node, level) AS (SELECT 'r0', 0 UNION SELECT e.dst, level + 1 FROM t JOIN e ON e.src = t.node WHERE level < 5)
    SELECT node, min(level)::INT AS level FROM t GROUP BY node""")
def bfs_levels(spark, d):
    return graph.closure(_edges(spark, d), spark.createDataFrame([("r0",)], "node string"))


@query(f"""WITH e AS ({_EDGES}) SELECT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT src, CASE WHEN src LIKE 'n%' THEN 1 ELSE 2 END FROM e""")
def topo_order(spark, d):
    return graph.levels(_edges(spark, d))


@query(f"""WITH e AS ({_EDGES}), x AS (SELECT DISTINCT 'n' || c_nationkey AS node FROM customer WHERE c_acctbal > 9900), b AS (SELECT node FROM x UNION SELECT e.src FROM e JOIN x ON e.dst = x.node),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, CASE WHEN node IN (SELECT node FROM b) THEN 'blocked' ELSE 'deployed' END AS status FROM n""")
def deploy_blocking(spark, d):
    e = _edges(spark, d)
    gone = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"))
    return graph.deployment(e, e.select(F.col("dst").alias("node")), gone)


@query(f"WITH e AS ({_EDGES}) SELECT src AS node, count(*) AS fan FROM e GROUP BY src")
def backlink_fan_in(spark, d):
    return _edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan"))


@query("""WITH o AS (SELECT n_regionkey AS k, n_nationkey, n_name, count(*) AS score FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, n_nationkey) AS p, lead(score, 1, 0) OVER (PARTITION BY k ORDER BY score DESC, n_nationkey) AS second FROM o)
    SELECT k AS n_regionkey, n_name, score FROM r WHERE p = 1 AND score >= 2 AND score > second""")
def option_ranking(spark, d):
    """The best option of each name, where it is strong and unique."""
    from pyspark.sql import Window

    o = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count("*").alias("score"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("score"), "n_nationkey")
    o = o.withColumn("p", F.row_number().over(w)).withColumn("second", F.lead("score", 1, 0).over(w))
    return o.filter("p = 1 AND score >= 2 AND score > second").select("n_regionkey", "n_name", "score")


# events and conversations -----------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def journal_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return ordered.latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts")


@query("SELECT event_type, user_id, count(*) AS approved_count, max(ts) AS last_used, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY ALL")
def term_counter_upsert(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("approved_count"), F.max("ts").alias("last_used"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS fresh FROM events")
def ttl_freshness(spark, d):
    e = table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return e.join(now).select("event_id", (F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("fresh"))


@query("""WITH l AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status FROM events GROUP BY ALL)
    SELECT month, row_number() OVER (PARTITION BY month ORDER BY user_id)::INT AS no, user_id, status FROM l""")
def monthly_dashboard(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    e = e.groupBy("month", "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return e.select("month", F.row_number().over(Window.partitionBy("month").orderBy("user_id")).alias("no"), "user_id", "status")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), 'none') AS probe, json_valid(props) AS valid FROM events")
def json_probe(spark, d):
    p = F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k"), F.lit("none"))
    return table(spark, d, "events").select("event_id", p.alias("probe"), F.expr("try_parse_json(props) IS NOT NULL").alias("valid"))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_activity(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context FROM conversations""")
def context_window(spark, d):
    return ordered.context(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query(r"""WITH o AS (SELECT conv_id, turn, lower(regexp_extract(text, '^[^\p{L}\p{N}]*([\p{L}\p{N}]+)', 1)) AS opener FROM conversations)
    SELECT conv_id, turn, opener, coalesce(opener <> '' AND lag(opener) OVER (PARTITION BY conv_id ORDER BY turn) = opener, false) AS monotone FROM o""")
def opener_monotony(spark, d):
    return ordered.repeats_opener(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "opener", "monotone")


@query(rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, len({_words('text')})::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    t AS (SELECT conv_id, turn, n, k, n AS s, 0 AS pack FROM c WHERE k = 1
      UNION ALL SELECT c.conv_id, c.turn, c.n, c.k, CASE WHEN t.s + c.n > 250 AND t.s > 0 THEN c.n ELSE t.s + c.n END, CASE WHEN t.s + c.n > 250 AND t.s > 0 THEN t.pack + 1 ELSE t.pack END
      FROM t JOIN c ON c.conv_id = t.conv_id AND c.k = t.k + 1)
    SELECT conv_id, turn, n, pack FROM t""")
def greedy_pack(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.words("text")).cast("long").alias("n"))
    return ordered.greedy_pack(c, "conv_id", "turn", "n", 250)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
    t AS (SELECT user_id, event_type, pos, k, pos AS last, true AS keep FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_type, e.pos, e.k, CASE WHEN e.pos - t.last > 300 THEN e.pos ELSE t.last END, e.pos - t.last > 300 FROM t JOIN e ON e.user_id = t.user_id AND e.event_type = t.event_type AND e.k = t.k + 1)
    SELECT user_id, event_type, pos AS event_id, keep FROM t""")
def overlink_filter(spark, d):
    return ordered.unlink_repeats(table(spark, d, "events"), "user_id", "event_id", "event_type", 300)


@query(ORACLES["journal_latest"])
def events_stream_latest(spark, d):
    """The journal as a stream: folded batch by batch, equal to the batch query."""
    import uuid

    from ..streaming.journal import latest_state, read_state

    graph.checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).select(e.columns)
    latest_state(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{folder}/state", f"{folder}/log").awaitTermination()
    return read_state(spark, f"{folder}/state").select("user_id", "event_type", "event_id", "ts")


def _consuming(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules without looking around, for RE2: the characters beside a match are taken and put back, and each rule runs twice, since of two matches that share such a character the first run sees one."""
    out = []
    for a, b in rules:
        begins, ends = a.startswith(localise.BEGINS), a.endswith(localise.ENDS)
        a = a.replace(localise.BEGINS, f"(^|[^{localise.WORDS}])").replace(localise.ENDS, f"([^{localise.WORDS}]|$)")
        if begins:
            b = "$1" + re.sub(r"(?<!\\)\$([0-9])", lambda m: f"${int(m[1]) + 1}", b)
        if ends:
            b += f"${re.compile(re.sub(r'\\p\{\w+\}', '', a)).groups}"
        out += [(a, b)] * (2 if begins or ends else 1)
    return out


@query(f"""SELECT doc_id, sha256(array_to_string(list_transform(parts, lambda p, i: {_rewritten('p', _consuming([*localise.CURRENCY_RULES, *localise.UNIT_RULES]))} || coalesce(kept[i], '')), '')) AS text_sha256
    FROM (SELECT doc_id, string_split_regex(text, '{localise.PROTECTED}') AS parts, regexp_extract_all(text, '{localise.PROTECTED}') AS kept FROM documents)""")
def currency_and_units(spark, d):
    """Texts with amounts and units in the target language's form, outside links, templates, references and code."""
    return _docs(spark, d).select("doc_id", F.sha2(localise.units(localise.currency("text")), 256).alias("text_sha256"))


@query(r"""SELECT page_id, count(DISTINCT href) AS n_targets, count(DISTINCT href) FILTER (WHERE href IN (SELECT '/' || item FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS item FROM benchmark))) AS n_known
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def media_audit(spark, d):
    """Link targets of each page and how many are on the list of known ones."""
    known = table(spark, d, "benchmark").select(F.explode(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("/"), w))).alias("href")).distinct().withColumn("known", F.lit(1))
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return links.join(known, "href", "left").groupBy("page_id").agg(F.count("*").alias("n_targets"), F.count("known").alias("n_known"))


@query("""WITH l AS (SELECT 't' || (user_id % 40) AS term, 'x' || (user_id % 3) AS target, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'proposed' WHEN 'error' THEN 'rejected' ELSE 'use' END AS action, ts, event_id FROM events)
    SELECT term, target, arg_max(action, struct_pack(a := ts, b := action)) FILTER (WHERE action <> 'use') AS status, count(*) FILTER (WHERE action = 'use') AS usage_count, min(ts) AS created_at, max(ts) AS updated_at FROM l GROUP BY ALL""")
def glossary_state(spark, d):
    """Candidate terms from a log of proposals, approvals, rejections and uses."""
    action = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "signup", "proposed").when(F.col("event_type") == "error", "rejected").otherwise("use")
    log = table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 40).alias("term"), F.concat(F.lit("x"), F.col("user_id") % 3).alias("target"), action.alias("action"), "ts")
    return localise.term_state(log)


@query()
def fuzzy_entities(spark, d):
    """Names of benchmark items and of conversations that are the same but for small changes, or name one entity by words, exonyms or stems."""
    a = table(spark, d, "benchmark").select(F.explode(T.matches("text", T.PROPER)).alias("a")).distinct()
    b = table(spark, d, "conversations").select(F.explode(T.matches("text", T.PROPER)).alias("b")).distinct()
    return resolve.same_entity(a, b)


# pages ------------------------------------------------------------------------------------


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(links).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages""")
def page_lang(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


_VISIBLE = r"regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, sha256(trim(regexp_replace({_VISIBLE}, '[ \t\r\n]+', ' ', 'g'))) AS text_sha256, length(trim(regexp_replace({_VISIBLE}, '[ \t\r\n]+', ' ', 'g')))::INT AS n_chars FROM pages")
def page_text(spark, d):
    t = T.visible("html")
    return table(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).alias("n_chars"))


@query(" UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, {_n('html', f'<{t}[ >]')}::INT AS opened, {_n('html', f'</{t}>')}::INT AS closed FROM pages WHERE {_n('html', f'<{t}[ >]')} <> {_n('html', f'</{t}>')}" for t in ("p", "b", "li", "ul", "article", "body", "html")))
def balance_check(spark, d):
    tags = F.array(*(F.struct(F.lit(t).alias("tag"), T.n_matches("html", f"<{t}[ >]").alias("opened"), T.n_matches("html", f"</{t}>").alias("closed")) for t in ("p", "b", "li", "ul", "article", "body", "html")))
    return table(spark, d, "pages").select("page_id", F.inline(tags)).filter("opened <> closed")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages")
def page_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug("url").alias("slug"))
