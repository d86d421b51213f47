"""Further cases of the training-data operators: clashing columns, collisions, hot rows, large blocks, cuts that flip, whole queries and the pipeline."""

import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import html_extract, ngram_join, quality_rules, queries, suffix_dedup, warc_fixity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def components(sets, percent):
    """Smallest id reachable by links, by all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] if s else d for i, (d, s) in enumerate(sets)}


def shingles(text, width):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("part", [3, 24, 1024])
def test_large_blocks_of_several_components(spark, monkeypatch, part):
    """Groups of near copies over one shared passage: blocks of several components, sizes over a class border, chains between parts."""
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(41)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for g in range(5):
        own = [f"g{g}x{i}" for i in range(40 + 3 * g)]
        for k in range(9):
            w = [*shared, *own]
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"n{g}{k}{rng.random()}"
            texts.append(" ".join(w))
    texts += [" ".join([*shared, *(f"l{g}y{i}" for i in range(8 + 4 * g))]) for g in range(10)]  # like all of them, linked to few
    chain = [f"c{i}" for i in range(100)]
    for k in range(25):
        texts.append(" ".join([*(f"d{j}" for j in range(2 * k)), *chain[2 * k :]]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 1, 90).collect()}
    want = components([(d, shingles(t, 1)) for d, t in rows], 90)
    assert got == want and 1 < len(set(want.values())) < 60


def test_quality_with_clashing_columns_and_collisions(spark):
    rng = random.Random(3)
    vocab = ["ab", "cd", "ef", "gh"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 70))), 7, "x", "y", "z") for i in range(60)] + [(None, None, 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, row string, w string, pattern string")
    out = quality_rules.quality(docs)
    assert out.columns.count("n_words") == 1 and Counter(r.n_words for r in out.collect()) == Counter(len(WORD.findall(t or "")) for _, t, *_ in rows)
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} <= {7, 1}

    def brute(text):
        w = text.split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        return len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)})

    for window in ("xxhash64(w[i], w[i + 1], w[i + 2])", "CAST(1 AS BIGINT)", "CAST(ascii(w[i]) AS BIGINT)"):  # real hashes, and such as collide
        for small in (1 << 21, 0):
            got = docs.filter("size(split(text, ' ')) > 2").select("text", F.split("text", " ").alias("w")).select("text", quality_rules.repeat_words(window, small).alias("n")).collect()
            assert got and all(r.n == brute(r.text) for r in got)


def test_verdicts_row_by_row(spark):
    """Expectation-maximisation over every row gives what it gives over counted vote patterns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counted = quality_rules.base_counts(docs, ["doc_id"])
    rows = [(r.d, [int(x) for x in r.v.split(",")], r.n_words, r.n_repeat_words) for r in counted.select(F.col("row.doc_id").alias("d"), F.concat_ws(",", *(v.cast("string") for _, v in quality_rules.votes())).alias("v"), "n_words", "n_repeat_words").collect()]
    k = len(rows[0][1])
    right, post = [quality_rules.START] * k, [0.0] * len(rows)
    for _ in range(quality_rules.ROUNDS):
        post = [1 / (1 + math.exp(-sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right, strict=True)))) for _, votes, _, _ in rows]
        for j in range(k):
            own = [(votes[j], p) for (_, votes, _, _), p in zip(rows, post, strict=True) if votes[j]]
            prior = 1 + quality_rules.PSEUDO * len(own)
            right[j] = (sum(p if v > 0 else 1 - p for v, p in own) + quality_rules.START * prior) / (len(own) + prior)
    want = {d: not (n < 50 or 100 * rep > 50 * n) and p >= quality_rules.THRESHOLD for (d, _, n, rep), p in zip(rows, post, strict=True)}
    assert {r.doc_id: r.kept for r in queries.op3_quality_rules(spark, SMALL).collect()} == want


def test_packing_query_uses_the_tokenizer_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> don't", "Foo<|endoftext|>Bar BAZ", "x <|endoftext|>, y\n<|STARTOFTEXT|> <|startoftext|>Z", None, "", "Ünï <| a |> I'M"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert got == want and got[3] == (1, zlib.crc32(bytes(4)))


def test_repeats_with_clashing_columns_and_repeated_rows(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90))
    passage = text()[:260]
    rows = [(1, text() + passage, "a", "b", 3, 4, 5), (2, passage + text(), "a", "b", 3, 4, 5), (None, None, None, None, None, None, None), (4, "", "a", "b", 3, 4, 5)] + [(5, text(), "a", "b", 3, 4, 5)] * 1
    rows += [(6, passage[:100] + text(), "a", "b", 3, 4, 5)] * 200  # one row that is most of the table
    docs = spark.createDataFrame(rows, "doc_id long, text string, settled string, spans string, rid long, _rid long, row long").repartition(5)
    out = suffix_dedup.remove_repeats(docs, length=200)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.settled, r.row) for r in out.collect())
    raw = [(t or "").encode() for _, t, *_ in rows]
    c = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = Counter()
    for (d, _, s, *_, r), b in zip(rows, raw, strict=True):
        gone = {i + k for i in range(len(b) - 199) if c[b[i : i + 200]] > 1 for k in range(200)}
        want[(d, bytes(x for i, x in enumerate(b) if i not in gone).decode(), s, r)] += 1
    assert got == want


def test_small_queries_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = components([(d, shingles(t, 3)) for d, t in docs], 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_join(spark, SMALL).collect()} == {d: (len(shingles(t, 3)), want[d]) for d, t in docs}
    for query, window, units in ((queries.op4_substring_dedup, 35, lambda t: tuple(WORD.findall(t))), (queries.op5_suffix_dedup, 400, str.encode)):
        own = {d: units(t or "") for d, t in docs}
        c = Counter(hash(u[i : i + window]) for u in own.values() for i in range(len(u) - window + 1))
        for r in query(spark, SMALL).collect():
            u = own[r.doc_id]
            gone = {i + k for i in range(len(u) - window + 1) if c[hash(u[i : i + window])] > 1 for k in range(window)}
            kept = [x for i, x in enumerate(u) if i not in gone]
            assert r.n_removed == len(gone)
            assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode() if window == 35 else bytes(kept)).hexdigest()


def test_cut_flips_unclear_blocks():
    prose = "This is a long and plain sentence of the article, with many words in it and a full stop at its end."
    # a short line without a sign of its own, between two paragraphs of one parent, is content by its neighbours
    page = f"<div><div class=content><p>{prose}</p><p>ok then</p><p>{prose}</p></div></div>"
    found = html_extract.blocks(page)
    weak = tuple(w - (1.0 if k == "good_name" else 0.0) for k, w in html_extract.EVIDENCE.items())
    keep, alone = html_extract.labelled(found, weak)
    assert keep == [True, True, True] and alone == [True, False, True]
    # a lone sentence among link lists is boilerplate by its neighbours
    page = "<div><ul>" + "".join(f"<li><a href=/{i}>Some link number {i} here</a></li>" for i in range(4)) + "</ul><div><p>Read it now.</p></div><ul>" + "".join(f"<li><a href=/{i}>Some link number {i} here</a></li>" for i in range(4)) + "</ul></div>"
    keep, _ = html_extract.labelled(html_extract.blocks(page))
    assert not any(keep)


def test_page_scan_takes_linear_time():
    for unit in ('<a "', "<a '\"> ", "<!-- ", "<script>", "<p><b>", "<a b='", "<", "&amp;<i>x", "</p", "<b><p>x</p>"):
        took = []
        for n in (60_000, 240_000):
            began = time.perf_counter()
            html_extract.main_text(unit * (n // len(unit)))
            took.append(time.perf_counter() - began)
        assert took[1] < 1.0 + 8 * took[0], unit
    began = time.perf_counter()
    list(html_extract.tags('<a "' * 262_144))
    assert time.perf_counter() - began < 1.0


def test_classifier_is_fitted_to_sure_blocks(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    w = dict(zip(html_extract.EVIDENCE, html_extract.fitted_weights(pages), strict=True))
    assert w["article"] > 0 > w["bad_tag"] and w["links"] < 0 and w != html_extract.EVIDENCE
    assert html_extract.fitted_weights(pages.limit(0)) == html_extract.PRIORS
    rows = [(None, None, "<article><p>A text of an article that stands here on its own.</p></article>"), (1, "u", None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in out) == [0, len("A text of an article that stands here on its own.")]


def test_held_out_blocks_are_labelled_right(spark):
    """Weights fitted to half of the pages label the sure blocks of the other half, without looking at the tags that make them sure."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = html_extract.fitted_weights(pages.filter("page_id % 2 = 0"))
    right = total = 0
    for r in pages.filter("page_id % 2 = 1").select("html").collect():
        found = html_extract.blocks(r.html)
        keep, _ = html_extract.labelled(found, w)
        for b, k in zip(found, keep, strict=True):
            if b.bad_tag or b.article and not b.bad_name:
                total += 1
                right += k == (not b.bad_tag)
    assert total > 1000 and right / total > 0.99


def test_warc_of_many_equal_rows_and_long_records(spark, tmp_path):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefghijklmnop") for _ in range(700))
    long = "y" * ((1 << 24) + 100) + body
    pages = spark.createDataFrame([(1, "http://x/1", body)] * 3000 + [(2, "http://x/2", long), (None, None, None)], "page_id long, url string, html string").repartition(6)
    path = str(tmp_path / "w")
    recs = warc_fixity.records(pages, archive_bytes=100_000)
    warc_fixity.write_archives(recs, path)
    sizes = {r.archive: r.n for r in warc_fixity.read_archives(spark, path).select("archive", F.length("content").alias("n")).collect()}
    assert len(sizes) > 5 and max(sizes.values()) < 300_000
    back = warc_fixity.parse(warc_fixity.read_archives(spark, path))
    assert back.filter("valid").groupBy("html").count().count() == 3 and back.count() == 3002
    ids, n = set(), 0
    for r in warc_fixity.read_archives(spark, path).collect():
        whole = gzip.decompress(bytes(r.content))  # any gzip reader can read an archive
        found = re.findall(rb"WARC-Record-ID: <([^>]+)>", whole)
        ids |= set(found)
        n += len(found)
    assert len(ids) == n == 3002
    out = warc_fixity.archive_and_audit(pages, archive_bytes=100_000)
    assert out.count() == 3002 and out.filter("fixity <> 'ok'").count() == 0


def test_pipeline_catches_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(77)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) + ("." if i % 12 == 11 else "") for i in range(n)).capitalize()
    clean = [(i, prose(120)) for i in range(40)]
    near = clean[0][1].split()
    near[50] = "changed"
    passage = prose(55)
    rows = clean + [(100, clean[3][1].upper().lower()), (101, " ".join(near)), (102, "### $$$ %%% " * 40), (103, prose(80) + " " + passage), (104, passage + " " + prose(80)), (105, None), (106, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    plain = {i for i, _ in clean}
    assert kept["quality_rules"] == plain | {100, 101, 103, 104}
    assert kept["exact_dedup"] == plain | {101, 103, 104} and kept["ngram_join"] == plain | {103, 104} == kept["suffix_dedup"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "suffix_dedup")).collect()}
    assert all(texts[i] == t for i, t in clean) and passage[10:-10] not in texts[103] + texts[104]
    assert kept["best_fit_packing"] == kept["suffix_dedup"]


def test_other_models_are_refused():
    from corpusmill.llm import best_fit_packing, piece_encoding

    with pytest.raises(ValueError):
        best_fit_packing.encode_texts([b"x"], public_tokenizers.path("byte_bpe_50k.json"), {})
    assert piece_encoding.model(public_tokenizers.path("piece_bpe_32k.model")).longest > 1


def test_long_segments_are_indexed_in_stretches(monkeypatch):
    import sentencepiece

    from corpusmill.llm import piece_encoding

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = piece_encoding.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(piece_encoding, "INDEXED", 37)
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(900)), "the cat " * 60, "ab" * 500]
    m.known.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == sp.encode(texts)


def test_exact_copies_in_small_slices(spark, monkeypatch):
    """Groups that go on from slice to slice keep one row each, with its own columns."""
    from corpusmill.llm import exact_dedup

    rows = [(i, ["Text A", "text a", "b", None, "", "TEXT A ", "é"][i % 7], i) for i in range(200)] + [(None, "b", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    monkeypatch.setattr(exact_dedup, "SLICE", 3)
    for keep, pick in (("min", min), ("max", max)):
        best = {}
        for i, t, _ in rows:
            if i is not None:
                key = (t or "").lower()
                best[key] = i if key not in best else pick(best[key], i)
        got = {(r.doc_id, r.text, r.n) for r in exact_dedup.drop_exact_copies(docs, keep=keep).collect()}
        assert got == {(i, rows[i][1], i) for i in best.values()}


def test_words_are_encoded_once_whatever_marks_follow():
    from tokenizers import Tokenizer

    from corpusmill.llm import best_fit_packing

    path = public_tokenizers.path("word_bpe_49k.json")
    known = {}
    best_fit_packing.encode_texts([b"kota kota, Kota. kota;", b"kota,\nkota"], path, known)
    assert set(known) == {b"kota", b",", b".", b";"}
    bits = ["don't", "<|endoftext|>", "<|ENDoftext|>", "Caf\u00e9", "cafe\u0301", "a.b", "a,,", "...", "\u00e9.", "\u00c9!", "\u00f7", "\u0301", "a\tb", "12,", "\u65e5\u672c", "a.\u0301", "\x1c", "a\xa0b", "z!?x", "", "\n"]
    rng = random.Random(3)
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for special_as_text in (False, True):
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert best_fit_packing.encode_texts([t.encode() for t in texts], path, {}, special_as_text) == want
