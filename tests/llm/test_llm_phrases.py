"""Collocations, alignment of tokenizers and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import alignment, collocations, decontamination

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, n_words long, hits string, w string, a long, key string, batch long, slots int"
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, lang, 1, "h", "w", 2, "k", 3, 4) for d, t, lang in rows], SCHEMA).repartition(parts)


def phrase_rows():
    rng = random.Random(8)
    vocab = ["the", "of", "New", "york", "city", "a\x01", "a", "é", "ÉA", "日本", "x\x1cy", "hall"] + ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(150):
        w = [rng.choice(vocab[: rng.choice([6, 14, 70])]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for x in w))
    texts += ["New York City hall"] * 12 + ["the\x0bof\x0cthe\rof", "...", " ", "", None, None, "a a a a a a a a a a a a a a a a", "of the " * 4000]
    return [(i * 3 - 50, t, rng.choice(["en", "de", None, "", "und"])) for i, t in enumerate(texts)] + [(7, texts[0], "en")] * 3


def brute_phrases(rows, most, least, covered, top):
    count, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for p in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", p)
            total[lang] += len(w)
            for m in range(1, most + 1):
                count[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        good = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in good.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(longer[g[i : i + m]], a)
        rows_ = []
        for g, a in good.items():
            if longer[g] and 100 * longer[g] >= covered * a:
                continue
            score, _, l, r = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("most", "least", "covered", "top"), [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 4, 90, 40)])
def test_collocations(spark, most, least, covered, top):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), most, least, covered, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, most, least, covered, top)


def test_collocations_in_small_pieces(spark, monkeypatch):
    """Windows parted into many parts, long texts cut, and an empty table."""
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "PART", 20)
    got = collocations.collocations(frame(spark, rows), 3, 3, 50, 9)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 3, 3, 50, 9)
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    data = np.frombuffer("aa bb. cc dd, ee. ".encode() * 50, np.uint8)
    import pyarrow as pa

    parts = list(collocations._stretches(pa.record_batch([pa.array([data.tobytes().decode()])], names=["text"]), 100))
    assert b"".join(d.tobytes() for d, _ in parts) == data.tobytes() and max(len(d) for d, _ in parts) < 130


def test_exact_scores_beyond_64_bits(spark):
    a = 3_000_000_007
    x = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long").select(F.struct(*(F.col(c).cast("decimal(16,0)").alias(c) for c in "alr")).alias("x"))
    assert x.select(F.expr("CAST(1000000 AS DECIMAL(7,0)) * x.a * x.a div (x.l * x.r)")).first()[0] == 1000000 * a * a // ((a + 1) * (a + 2))


def test_radix_order():
    rng = np.random.default_rng(2)
    keys = rng.choice(np.array([0, 1, 65535, 65536, 70000, 2**32 - 1], np.uint32), (5000, 3))
    assert (keys[collocations.radix_order(keys)] == keys[np.lexsort(keys.T[::-1])]).all()
    k, n = collocations.run_lengths(keys, np.ones(5000, np.int64))
    assert Counter(map(tuple, keys.tolist())) == {tuple(x): c for x, c in zip(k.tolist(), n.tolist(), strict=True)}


def alignment_rows():
    rng = random.Random(4)
    bits = ["the cat", "don't I'M", "naïve café", "日本語 の", "a  b", " x", "tail ", "\n\n new", "<|endoftext|>", "<s> </s>", "<0x0A>", "▁ under▁line", "x  y", "1234 5678", "　 wide", "z   q", "🎉🎉 🎉", "====== ====", "\x1c s", "é ́", "\x00 \x01", "a\u0085 b", "ﬁ ﬂ"]
    texts = [rng.choice([" ", ""]).join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += [None, "", " ", "  ", "a", "the " * 3000, "ab" * 900, "é" * 500, texts[0], texts[0]]
    return [(i * 5 - 9, t, "en") for i, t in enumerate(texts)] + [(3, texts[5], "en")] * 2


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # byte-level alphabet: visible Latin-1 stands for itself, the others follow from 256 on
    back, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            back[chr(b)] = b
        else:
            back[chr(256 + k)], k = b, k + 1
    docs, count = [], Counter()
    for d, t, _ in rows:
        a, b, links, text = [], [], [], ""
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
            ba = [bytes(back[c] for c in ta.id_to_token(i)) for i in a]
            bb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
                a, b, ba, bb = [], [], [], []
            ends = sorted(set(np.cumsum([len(x) for x in ba]).tolist()) & set(np.cumsum([len(x) for x in bb]).tolist()))
            of = lambda parts: np.searchsorted(ends, np.cumsum([len(x) for x in parts])).tolist() if parts else []
            ga, gb = of(ba), of(bb)
            groups = [([x for x, g in zip(a, ga) if g == k], [y for y, g in zip(b, gb) if g == k]) for k in range(len(ends))]
            links = [(x, y) for xs, ys in groups for x in xs for y in ys]
            text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
            count.update(set(links))
        docs.append((d, len(a), len(b), text.count("|"), links, text))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return count, sorted((d, na, nb, ng, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(t.encode()).hexdigest() if t else "", t) for d, na, nb, ng, ls, t in docs)


def test_alignment(spark, monkeypatch):
    rows = alignment_rows()
    count, want = brute_alignment(rows)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert any(w[1] == 0 for w in want) and any(w[4] > w[3] for w in want)
    for salted in (False, True):
        if salted:
            monkeypatch.setattr(alignment, "SCORED", 1)
        made = alignment.Alignment(frame(spark, rows), *paths, keep_groups=True)
        got = made.documents().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
        assert sorted(map(tuple, got.collect())) == want
        assert {(r.a, r.b): r["count"] for r in made.pairs().collect()} == dict(count)
    out = alignment.align(frame(spark, []).limit(0), *paths, keep_groups=False)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def leak_rows():
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(40)] + ["É", "naïve", "日本", "x9"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([10, 11, 14, 30])))) for i in range(12)] + [(100, "w1 w2 w3 w1 w2 w3"), (21, "Q"), (22, "q"), (23, "... "), (24, None), (25, ""), (None, "w1"), (30, "p p p p p p p p p p p p"), (31, "one two"), (31, "three FOUR five")]
    docs = []
    for k in range(80):
        w = say(rng.randint(0, 40))
        if k % 3 == 0:
            src = ITEM.findall(ascii_lower(rng.choice(items[:13])[1]))
            a = rng.randint(0, max(0, len(src) - 10))
            w[rng.randint(0, len(w)) :] = src[a : a + rng.randint(8, 16)] + say(5)
        docs.append("".join(x.upper() * (rng.random() < 0.2) or x + rng.choice([" ", ", ", "\n", "-", " (", "@"]) for x in w))
    docs += [None, "", "...", "Q", "p " * 15, "p-" * 30 + "end", "one. TWO", "three four five six", " ".join(say(20_000)) + " " + items[0][1] + "!", items[1][1], items[1][1]]
    return [(i - 5, t, "en") for i, t in enumerate(docs)] + [(2, docs[3], "en")] * 2, items


def brute_leaks(rows, items, window=10):
    grams = defaultdict(set)
    for i, t in items:
        w = ITEM.findall(ascii_lower(t or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                grams[tuple(w[k : k + window])].add(str(i))
    out, cleaned = [], []
    for d, t, _ in rows:
        w, hit, own = ITEM.findall(ascii_lower(t or "")), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    own |= ids
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
        parts = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
        tail = re.search(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\Z", t or "")[0]
        cleaned.append((d, t if not hit else "".join(p for k, p in enumerate(parts) if k not in hit) + tail))
    return sorted(out), cleaned


@pytest.mark.parametrize("set_rows", [200_000, 0])
def test_decontamination(spark, set_rows):
    rows, items = leak_rows()
    docs, bench = frame(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    want, cleaned = brute_leaks(rows, items)
    out = decontamination.report(docs, bench, set_rows=set_rows)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + decontamination.COUNTS
    assert sorted(r.doc_id for r in out.filter("contaminated AND n_hit > 1").collect()) == [r[0] for r in want if r[2] > 1]
    got = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == want
    key = lambda r: (r[0], r[1] or "")
    spans = decontamination.decontaminate(docs, bench, remove="spans", set_rows=set_rows)
    assert spans.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in spans.collect()), key=key) == sorted(cleaned, key=key)
    whole = decontamination.decontaminate(docs, bench, set_rows=set_rows)
    clean = Counter(r[0] for r in want if not r[-1])
    assert Counter(r.doc_id for r in whole.collect()) == clean and whole.columns == docs.columns


def test_decontamination_of_nothing(spark):
    rows, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.report(frame(spark, []).limit(0), bench).count() == 0
    out = decontamination.report(frame(spark, rows), bench.limit(0)).collect()
    assert len(out) == len(rows) and not any(r.contaminated or r.n_hit or r.n_items for r in out)
    assert {r.items_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}


def test_decontamination_is_one_scan_without_python(spark):
    rows, items = leak_rows()
    plan = decontamination.report(frame(spark, rows, 2), spark.createDataFrame(items[:12], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("Subqueries")[0] and "ArrowEval" not in plan


def test_packed_rows_are_small_and_batches_bounded(spark, monkeypatch):
    """Rows of a few MB at most leave a task, whatever it gathers, and no Python worker gets batches of Spark's own size."""
    from corpusmill.llm import common

    rng = np.random.default_rng(6)
    monkeypatch.setattr(collocations, "PACKED", 500)
    codes = rng.integers(1, 3000, 20_000).astype(np.uint32)
    own = pa.array([[{"place": k, "id": k} for k in range(1, 3000)]], pa.list_(pa.struct([("place", pa.int64()), ("id", pa.int64())])))
    batch = pa.record_batch([pa.array(["en"]), pa.array([len(codes)]), pa.array([common.planes(codes)], pa.binary()), own], names=["lang", "n_codes", "codes", "ids"])
    rows = [r for b in collocations._count_grams(3)(iter([batch, batch])) for r in b.to_pylist()]
    assert max(r["size"] for r in rows) == 500
    total = Counter()
    for r in rows:
        keys, n = collocations._unpacked(pa.scalar(r["data"], pa.binary()), r["size"], 3)
        total.update(dict(zip(map(tuple, keys.tolist()), n.tolist(), strict=True)))
    want = Counter(map(tuple, collocations.grams(codes, 3).tolist()))
    assert total == Counter({k: 2 * v for k, v in want.items()})
    seen = []
    whole = common.in_arrow
    monkeypatch.setattr(collocations, "in_arrow", lambda df, work, schema: seen.append(df) or whole(df, work, schema))
    assert sorted(map(tuple, collocations.collocations(frame(spark, phrase_rows()), 3, 10, 50, 2000).collect())) == brute_phrases(phrase_rows(), 3, 10, 50, 2000)
    assert len(seen) == 4
