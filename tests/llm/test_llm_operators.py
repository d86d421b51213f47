"""Every training-data operator against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import best_fit_packing, common, exact_dedup, html_extract, ngram_join, piece_encoding, quality_rules, repeats, substring_dedup, suffix_dedup, token_counts, warc_fixity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, fp long, bucket int, seq long"


def ascii_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties, odd white space and one very long text."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(70)
    texts = [prose(rng.randint(3, 300)) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), texts[4], passage, passage + " " + prose(50), prose(60) + "\n" + passage]
    for base in (texts[10], texts[11], texts[12]):
        for _ in range(4):
            w = base.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [None, None, "", " \t\n ", "a", "a b", "A  B", "\x0b x \x0c y \x1c z  w", prose(9000), "ab " * 400, "x" * 1500, "Σίσυφος ΟΔΟΣ 日本語 🎉", "<|endoftext|> don't I'M"]
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (10_000, texts[6]), (10_001, texts[6])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3, 4) for d, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    out = best_fit_packing.pack_documents(docs, path).collect()
    want = Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(d, k, a, len(ids[a : a + 2048]), tuple(ids[a : a + 2048]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, tuple(r.ids)) for r in out) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 2048) + 2
    assert best_fit_packing.pack_documents(nothing, path).count() == 0


def test_packing_plan_is_near_the_bound_and_whole():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000, 60_000):
        lengths = np.minimum(2048, (np.exp(rng.normal(6, 1, n)) + 1).astype(int))
        h = np.bincount(lengths, minlength=2049)
        plan = best_fit_packing.plan_packing(h)
        used = np.zeros(2049, np.int64)
        for content, many in plan:
            assert sum(content) <= 2048
            np.add.at(used, content, many)
        assert (used == h).all()
        count, least = sum(m for _, m in plan), -(-int(lengths.sum()) // 2048)
        assert count <= least * 1.01 + 2


def test_ngram_join(docs, rows, nothing):
    for width, percent in ((3, 90), (5, 80)):
        sets = []
        for d, t in rows:
            w = WORD.findall(ascii_lower(t or ""))
            s = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
            sets.append((d, s))
        root = list(range(len(sets)))

        def find(i, root=root):
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
        want = Counter((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets))
        assert Counter(tuple(r) for r in ngram_join.ngram_join(docs, width, percent).collect()) == want
    assert ngram_join.ngram_join(nothing).count() == 0
    assert ngram_join.keep_one_of_each(docs).columns == docs.columns


def test_one_of_each_keeps_unlinked_rows_with_null_and_reused_ids(spark):
    rng = random.Random(23)
    prose = lambda: [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(60)]
    rows = []
    for i in range(24):
        w = prose()
        near = " ".join([*w[:-1], "changed"])
        ids = [(None, None), (None, i), (i, None), (7, 7), (i, i + 100), (7, None)][i % 6]
        rows += [(ids[0], " ".join(w)), (ids[1], near)] if i % 3 else [(ids[0], " ".join(w))]
    rows += [rows[0], rows[3], (None, None), (None, ""), (None, " \n"), (3, None), (3, "\t"), (7, "one two"), (7, "two one"), (None, "two one")]
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    got = Counter(tuple(r) for r in ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    least = lambda own: min(((d is None, d or 0) for d, _ in own))
    assert got.total() == len(groups)
    for own in groups.values():
        best = {row for row in own if (row[0] is None, row[0] or 0) == least(own)}
        assert sum(got[row] for row in best) >= 1
    assert {t for _, t in got} >= {None, "", " \n", "\t"}


def test_segment_keys_lose_no_pair():
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        for n in (2, 9, 11, 40, 333, 2500):
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                most = int(len(a) * 2 * (100 - percent) / (100 + percent)) // 2
                b = np.unique(np.concatenate([rng.permutation(a)[most:], rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                k, r, need = ngram_join.segment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert len(set(k[r == 0].tolist()) & set(k[r == 1].tolist())) >= max(need)


def test_large_blocks_are_parted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[:i], f"n{i}", *words[i + 1 :]])) for i in range(30)] + [(99, "something else")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()}
    assert all(got[i] == 0 for i in range(30)) and got[99] == 99


def test_quality_counts(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality(docs).collect())
    want = Counter()
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        rep = len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want[(d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)] += 1
    assert got == want
    assert quality_rules.quality(nothing).count() == 0


def test_quality_verdicts(spark):
    clean = "The quick brown fox jumps over the lazy dog near the old river bank today. "
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(clean.split()) + chr(97 + rng.randrange(26)) for _ in range(90)) + "."
    rows = [(i, prose()) for i in range(60)] + [(100 + i, " ".join(f"{w}%%%" for w in prose().split())) for i in range(8)] + [(200 + i, " ".join(f"{w}!!" for w in prose().upper().split())) for i in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in got if i >= 100)


def test_quality_is_native(docs):
    plan = quality_rules.base_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substring_dedup(docs, rows, nothing):
    seqs = [WORD.findall(t or "") for _, t in rows]
    for window in (35, 24):
        c = Counter(tuple(w[i : i + window]) for w in seqs for i in range(len(w) - window + 1))
        want = Counter()
        for (d, _), w in zip(rows, seqs, strict=True):
            gone = {i + k for i in range(len(w) - window + 1) if c[tuple(w[i : i + window])] > 1 for k in range(window)}
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
        assert Counter(tuple(r) for r in substring_dedup.substring_dedup(docs, window).collect()) == want
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_cover_holds_every_difference():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_suffix_dedup(docs, rows, nothing):
    raw = [(t or "").encode() for _, t in rows]
    for length in (400, 60):
        c = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
        want = Counter()
        for (d, _), b in zip(rows, raw, strict=True):
            gone = bytearray(len(b))
            for i in range(len(b) - length + 1):
                if c[b[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
            want[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
        assert Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs, length).collect()) == want
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.filter("n_chars <> length(text)").count() == 0 and out.count() == len(rows)


def test_interval_tree_reaches():
    rng = random.Random(4)
    for _ in range(40):
        items = sorted({("".join(rng.choice("ab") for _ in range(rng.randint(4, 12))).encode(), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode()) for _ in range(rng.randint(2, 14))})
        right, left = [r for r, _ in items], [x for _, x in items]
        l, r = suffix_dedup.interval_tree(right, left, 9)
        for i in range(len(items)):
            pairs = [(suffix_dedup._common(left[i], left[j]), suffix_dedup._common(right[i], right[j])) for j in range(len(items)) if j != i]
            pairs = [(a, b) for a, b in pairs if a + b >= 9]
            assert (l[i], r[i]) == (max([a for a, _ in pairs], default=0), max([b for _, b in pairs], default=0))


def test_html():
    page = """<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, please accept them all to go on reading here.</div>
    <div id="content"><h1>Title &amp; more</h1><p>First paragraph of real text, long enough to count as content without any doubt.<p>Short one.
    <p>Second <b>bold</b>\n  text with <a href=x>one link</a> and a good many more words after it, to be long.</p></div>
    <aside><p>Sidebar text that is long and looks like prose, but is no content at all, really.</p></aside><script>var t="</p>";</script><!-- <p>hidden</p> -->
    <section class="comments"><p>A reader says: a long comment that goes on and on, with sentences. It is prose.</p></section><form><p>Subscribe now</p></form><footer>(c)</footer>"""
    got = html_extract.main_text(page)
    assert got == "Title & more\n\nFirst paragraph of real text, long enough to count as content without any doubt.\n\nShort one.\n\nSecond bold text with one link and a good many more words after it, to be long."
    assert html_extract.main_text("") == "" and html_extract.main_text("<script>x") == "" and html_extract.main_text("<!-- a") == ""


def test_html_rows(spark, nothing):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>Some text of an article that is here.</p></article>"), (3, "u", "<article><p>Some text of an article that is here.</p></article>"), (4, "v", "<p>" * 3000 + "x" * 200_000 + ".")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter({(1, 0): 1, (2, 0): 1, (3, 37): 2, (4, 200_001): 1})


def test_minimum_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep, s=scores, e=edges: sum(-x if x < 0 and k else x if x > 0 and not k else 0 for x, k in zip(s, keep, strict=True)) + sum(w for a, b, w in e if keep[a] != keep[b])
        got = html_extract.minimum_cut(scores, edges)
        assert cost(got) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i}\r\n\r\nWARC/1.1\r\nü</p>" * (i % 5)) for i in range(90)] + [(90, None, None), (91, "http://x/a b\n", ""), (5, "http://x/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    recs = common.cut(warc_fixity.records(pages, archive_bytes=600))
    warc_fixity.write_archives(recs, str(tmp_path / "w"))
    files = warc_fixity.read_archives(spark, str(tmp_path / "w"))
    back = warc_fixity.parse(files).filter("valid").collect()
    assert Counter(r.html for r in back) == Counter(h or "" for *_, h in rows)
    manifest = common.cut(warc_fixity.manifest(recs))
    clean = warc_fixity.hash_records(files, manifest)
    assert warc_fixity.audit(warc_fixity.merkle_tree(manifest, 4), warc_fixity.merkle_tree(clean, 4), 4).count() == 0
    hit = manifest.orderBy("archive", "seq").collect()[7]
    flip = F.when(F.col("archive") == hit.archive, F.concat(F.expr(f"substring(content, 1, {hit.offset + 30})"), F.lit(b"?"), F.expr(f"substring(content, {hit.offset + 32})"))).otherwise(F.col("content"))
    bad = warc_fixity.hash_records(files.withColumn("content", flip), manifest)
    found = warc_fixity.audit(warc_fixity.merkle_tree(manifest, 4), warc_fixity.merkle_tree(bad, 4), 4).collect()
    assert [(r.archive, r.seq, r.status) for r in found] == [(hit.archive, hit.seq, "corrupt")]
    last = manifest.filter(F.col("archive") == hit.archive).agg(F.max("seq")).first()[0]
    cutoff = F.when(F.col("archive") == hit.archive, F.expr(f"substring(content, 1, {hit.offset})")).otherwise(F.col("content"))
    gone = warc_fixity.audit(warc_fixity.merkle_tree(manifest, 4), warc_fixity.merkle_tree(warc_fixity.hash_records(files.withColumn("content", cutoff), manifest), 4), 4).collect()
    assert {(r.seq, r.status) for r in gone} == {(s, "missing") for s in range(hit.seq, last + 1)}
    out = warc_fixity.archive_and_audit(pages)
    assert out.count() == len(rows) and out.filter("fixity <> 'ok'").count() == 0
    assert warc_fixity.archive_and_audit(spark.createDataFrame([], pages.schema)).count() == 0


def test_pieces(docs, rows, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_encoding.encode_documents(docs, path)
    want = Counter((d, tuple(sp.encode(t or ""))) for d, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
    assert out.filter("NOT round_trip").count() == 0
    assert Counter((r.doc_id, r.text) for r in piece_encoding.decode_documents(out, path).collect()) == Counter((d, t or "") for d, t in rows)
    assert piece_encoding.encode_documents(nothing, path).count() == 0


def test_pieces_on_odd_text():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), piece_encoding.model(path)
    rng = random.Random(1)
    odd = ["".join(rng.choice("aab▁ \n\tthe ,.日本é①𝒳0123<>|-") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", " ", "a" * 4000, "▁" * 40, "\x00a", "ab" * 2000]
    ids = m.encode(odd)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == sp.encode(odd)
    assert [m.decode(x) for x in ids] == [sp.decode(x) for x in sp.encode(odd)]


def test_exact_dedup(docs, rows, nothing):
    norm = [(d, ascii_lower(t or "")) for d, t in rows]
    size = Counter(t for _, t in norm)
    for keep, pick in (("min", min), ("max", max)):
        best = {}
        for d, t in norm:
            best[t] = pick(d, best.get(t, d))
        want = Counter((d, best[t], size[t], d == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
        assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, keep).collect()) == want
        left = exact_dedup.drop_exact_copies(docs, keep)
        assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(best.values())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_of_one_large_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("Same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(df.union(spark.createDataFrame([(None, "same")], "doc_id long, text string")), "max")
    assert got.filter("group_size = 2001").count() == 2001 and got.filter("kept").count() == 1001 and got.filter("group_size > 1").select("keep_id").distinct().first()[0] == 2998


def test_token_counts(docs, rows, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = token_counts._encoder(path, public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t in rows)
    h = token_counts.length_histogram(token_counts.encoded_lengths(docs, path, public_tokenizers.PATTERN)).cache()
    assert {r.n_tokens: r.n_docs for r in h.collect()} == Counter(n)
    for r in token_counts.limit_table(h).collect():
        assert r.all_tokens == sum(n) and r.docs_longer == sum(x > r.n_tokens for x in n) and r.tokens_longer == sum(x for x in n if x > r.n_tokens)
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in n)
    assert token_counts.truncated_total(h, 100) == sum(min(x, 100) for x in n)
    assert token_counts.length_quantile(h, 0.5) == n[-(-len(n) // 2) - 1]
    none = token_counts.length_histogram(token_counts.encoded_lengths(nothing, path, public_tokenizers.PATTERN))
    assert none.count() == 0 and token_counts.limit_table(none).count() == 0 and token_counts.length_quantile(none, 0.5) is None


def test_connected(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 530)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "suffix_dedup", "best_fit_packing"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    empty = tmp_path / "none"
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_common_seeds_are_dealt_out_and_counted(spark, docs, rows, monkeypatch):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [" ".join([*(rng.choice(vocab) for _ in range(rng.randint(0, 30))), passage, *(rng.choice(vocab) for _ in range(rng.randint(0, 30)))]) for _ in range(120)] + [passage, passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    for op, args in ((substring_dedup.substring_dedup, (35,)), (suffix_dedup.suffix_dedup, (200,))):
        want = Counter(tuple(r) for r in op(df, *args).collect())
        for deal, count in ((2, 1 << 30), (2, 5), (1000, 5)):
            monkeypatch.setattr(repeats, "DEAL", deal)
            monkeypatch.setattr(repeats, "COUNT", count)
            assert Counter(tuple(r) for r in op(df, *args).collect()) == want
        monkeypatch.undo()


def test_periodic_short_texts_are_not_their_own_repeats(spark):
    """A text little longer than a window, with a period inside, holds equal seeds in one context that occurs once."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(6))
    texts = []
    for n in range(35, 57):
        for period in (1, 5, 20, 21, n // 2):
            line = [word() for _ in range(period)]
            texts.append(" ".join((line * n)[:n]))
            lead, line = rng.randrange(8), [word() for _ in range(period)]  # the period begins and ends inside the text
            texts.append(" ".join([*(word() for _ in range(lead)), *(line * n)[: n - lead - 1], word()]))
    for n in range(400, 601, 8):
        for period in (1, 37, 150, 199, 210):
            line, other = ("".join(rng.choice("abcdefgh ") for _ in range(period)) for _ in range(2))
            texts += [(line * n)[:n], "<" + (other * n)[: n - 2] + ">"]
    texts += [texts[2], texts[5], texts[5] + " tail", texts[-2], "head " + texts[-4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    for op, window, units in ((substring_dedup.substring_dedup, 35, [tuple(WORD.findall(t)) for t in texts]), (suffix_dedup.suffix_dedup, 400, [t.encode() for t in texts])):
        c = Counter(u[i : i + window] for u in units for i in range(len(u) - window + 1))
        want = {d: len({i + k for i in range(len(u) - window + 1) if c[u[i : i + window]] > 1 for k in range(window)}) for d, u in enumerate(units)}
        assert sum(n == 0 and len(units[d]) >= window for d, n in want.items()) > 20 and any(want.values())
        assert {r.doc_id: r.n_removed for r in op(df, window).collect()} == want
