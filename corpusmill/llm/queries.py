"""Queries over the driver's tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, best_fit_packing, collocations, decontamination, exact_dedup, html_extract, ngram_join, piece_encoding, quality_rules, substring_dedup, suffix_dedup, token_counts, warc_fixity


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return best_fit_packing.pack_documents(docs, _tokenizers().path("word_bpe_49k.json"), limit=2048, end_id=0, keep_ids=False, special_as_text=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.quality(docs, columns=["doc_id"]).drop("n_upper", "n_bangs")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), window=35, keep_text=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), length=400, keep_text=False)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.archive_and_audit(_table(spark, sf_dir, "pages"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_documents(_table(spark, sf_dir, "documents"), _tokenizers().path("piece_bpe_32k.model"), keep_ids=False)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizers = _table(spark, sf_dir, "documents"), _tokenizers()
    lengths = token_counts.encoded_lengths(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return token_counts.limit_table(token_counts.length_histogram(lengths))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), most=3, least=10, covered=50, top=2000)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizers = _table(spark, sf_dir, "documents"), _tokenizers()
    return alignment.align(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), keep_groups=False)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(docs, _table(spark, sf_dir, "benchmark"), window=10).drop("text", "items")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
        "op11_collocations": r"""
            WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM low),
            seqs AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
            runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM seqs),
            each AS (SELECT lang, w[i] AS w1, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS w2, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS w3 FROM runs),
            one AS (SELECT lang, w1, count(*) AS f FROM each GROUP BY ALL),
            two AS (SELECT lang, w1, w2, count(*) AS f FROM each WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
            three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM each WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
            cuts AS (
                SELECT lang, w1 || ' ' || w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r FROM two
                JOIN one x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM one) y USING (lang, w2)
                UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 1, three.f, x.f, y.f FROM three
                JOIN one x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM two) y USING (lang, w2, w3)
                UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 2, three.f, x.f, y.f FROM three
                JOIN two x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM one) y USING (lang, w3)),
            scores AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
            best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            inside AS (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM three UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three),
            longest AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
            kept AS (SELECT b.* FROM best b LEFT JOIN longest g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
            SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
            FROM ranked JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000""",
        "op13_decontamination": r"""
            WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            g AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
            places AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
            hits AS (SELECT rid, i, m, item_id FROM places JOIN g USING (m, gram)),
            covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
            items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)""",
    }
