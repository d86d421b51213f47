"""Queries over nested markup.  The tables hold none, so parts of the documents' own words become marks: every text nests in its own way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, reviews, tree
from ..sources.tables import table
from .catalogue import _PAIRS, _words, query

BRACES, BRACKETS = [("er", "{{"), ("on", "}}")], [("th", "[["), ("an", "]]")]


def _marked(spark: SparkSession, d: str, marks: list[tuple[str, str]]) -> DataFrame:
    text: Column = F.coalesce("text", F.lit(""))
    for word, mark in marks:
        text = F.replace(text, F.lit(word), F.lit(mark))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def _marked_sql(marks: list[tuple[str, str]]) -> str:
    text = "coalesce(text, '')"
    for word, mark in marks:
        text = f"replace({text}, '{word}', '{mark}')"
    return text


def _tokens(marks: list[tuple[str, str]], begin: str, end: str, pattern: str) -> str:
    """Tokens of one kind with their place and level: the running sum of marks, less its lowest value so far, which strays make."""
    return f"""d AS (SELECT doc_id, {_marked_sql(marks)} AS x FROM documents),
    l AS (SELECT doc_id, string_split_regex(x, '{pattern}') AS parts, regexp_extract_all(x, '{pattern}') AS toks FROM d),
    t AS (SELECT doc_id, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok, unnest(parts[:len(toks)]) AS part FROM l),
    c AS (SELECT *, sum(CASE tok WHEN '{begin}' THEN 1 ELSE -1 END) OVER w AS cum, sum(length(part) + 2) OVER w - 2 AS pos FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    m AS (SELECT *, least(0, min(cum) OVER (PARTITION BY doc_id ORDER BY i)) AS low, coalesce(least(0, min(cum) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS before FROM c),
    p AS (SELECT doc_id, i, tok, pos, low < before AS stray, lead(tok) OVER v AS partner, lead(pos) OVER v AS until FROM m WINDOW v AS (PARTITION BY doc_id, low < before, cum - low + CASE tok WHEN '{end}' THEN 1 ELSE 0 END ORDER BY i)),
    s AS (SELECT doc_id, pos::INT AS "begin", (until + 2)::INT AS "end" FROM p WHERE tok = '{begin}' AND partner = '{end}' AND NOT stray)"""


_BRACES = _tokens(BRACES, "{{", "}}", r"\{\{|\}\}")
_BRACKETS = _tokens(BRACKETS, "[[", "]]", r"\[\[|\]\]")


@query(f'WITH {_BRACES} SELECT doc_id, "begin", "end" FROM s')
def nested_spans(spark, d):
    """Closed spans at any depth."""
    rows = _marked(spark, d, BRACES).select("doc_id", F.explode(F.filter(tree.spans("text"), lambda s: s["state"] == "closed")).alias("s"))
    return rows.select("doc_id", "s.begin", "s.end")


_COUNTS = "SELECT doc_id, '{}' AS kind, (count(*) FILTER (stray))::INT + (count(*) FILTER (NOT stray AND tok = '{}' AND partner IS NULL))::INT AS n FROM p GROUP BY doc_id"


@query(f"SELECT * FROM (WITH {_BRACES} {_COUNTS.format('template', '{{')}) WHERE n > 0 UNION ALL SELECT * FROM (WITH {_BRACKETS} {_COUNTS.format('link', '[[')}) WHERE n > 0")
def unpaired_marks(spark, d):
    """Marks without a partner, by kind."""
    return _marked(spark, d, BRACES + BRACKETS).select("doc_id", F.inline(tree.unpaired("text"))).filter("n > 0 AND kind IN ('link', 'template')")


_LINE = [("\n", " "), *BRACES]


@query(f"""WITH {_tokens(_LINE, "{{", "}}", chr(92) + "{" + chr(92) + "{|" + chr(92) + "}" + chr(92) + "}")},
    e AS (SELECT doc_id, string_agg(part || CASE WHEN low < before THEN '' ELSE tok END, '' ORDER BY i) AS head, max_by(cum - low, i)::INT AS open FROM m GROUP BY doc_id)
    SELECT doc_id, coalesce(head, '') || parts[-1] || repeat('}}}}', coalesce(open, 0)) AS text FROM l LEFT JOIN e USING (doc_id)""")
def nested_repair(spark, d):
    """Strays go, open templates end with their line; each text is one line, and the whole of it is compared."""
    return _marked(spark, d, _LINE).select("doc_id", tree.repair(F.col("text"), "template").alias("text"))


@query(f"""WITH {_BRACES}, w AS (SELECT doc_id, string_split(x, 'in') AS parts FROM d),
    a AS (SELECT doc_id, unnest(range(1, len(parts))) AS i, unnest(parts[:len(parts) - 1]) AS part FROM w),
    b AS (SELECT doc_id, sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS place FROM a)
    SELECT doc_id, count(*) AS n_pairs, count(DISTINCT place) AS n_inside, max("end" - "begin")::INT AS widest FROM b JOIN s USING (doc_id) WHERE "begin" <= place AND place + 2 <= "end" GROUP BY doc_id""")
def found_inside(spark, d):
    """Matches and the spans that hold them, by a join of two tables on bins."""
    docs = _marked(spark, d, BRACES)
    points = tree.found_in_prose(docs, "in", kinds=())
    held = docs.select("doc_id", F.explode(F.filter(tree.spans("text"), lambda s: s["state"] == "closed")).alias("s")).select("doc_id", F.col("s.begin").alias("from"), F.col("s.end").alias("to"))
    both = tree.around(points, held)
    return both.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_distinct("begin").alias("n_inside"), F.max(F.col("to") - F.col("from")).alias("widest"))


@query(f"""WITH p AS (SELECT source_id, draft_id, string_split_regex(lower(source_text), '[.!?\\n]+') AS ss, {_words('lower(draft_text)')} AS have FROM {_PAIRS}),
    s AS (SELECT source_id, draft_id, k, words FROM (SELECT source_id, draft_id, unnest(range(len(ss))) AS k, unnest(list_transform(ss, lambda s: {_words('s')})) AS words FROM p) WHERE len(words) >= 4),
    a AS (SELECT source_id, draft_id, k, w, count(*) AS n FROM (SELECT source_id, draft_id, k, unnest(words) AS w FROM s) GROUP BY ALL),
    b AS (SELECT source_id, draft_id, w, count(*) AS m FROM (SELECT source_id, draft_id, unnest(have) AS w FROM p) GROUP BY ALL),
    r AS (SELECT source_id, draft_id, k, 10 * sum(least(n, coalesce(m, 0))) < 6 * sum(n) AS lost FROM a LEFT JOIN b USING (source_id, draft_id, w) GROUP BY ALL)
    SELECT source_id, draft_id, coalesce(n, 0)::INT AS n_sentences, coalesce(l, 0)::INT AS n_lost FROM p
    LEFT JOIN (SELECT source_id, draft_id, count(*) AS n, count(*) FILTER (lost) AS l FROM r GROUP BY ALL) USING (source_id, draft_id)""")
def retained_sentences(spark, d):
    """Sentences of each document that the next one of its source has lost, word for word as bags."""
    pairs = audits.pairs_in_order(table(spark, d, "documents").select("doc_id", "text", "source"))
    return reviews.retention(pairs, plain=lambda t: t)
