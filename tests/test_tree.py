"""Nested markup: spans, repair, places and the join of points with intervals."""

import random
import time

from pyspark.sql import functions as F

from corpusmill.operators import reviews, rewrites, tree


def brute(text, begin, end):
    """Closed spans of one kind by a plain stack."""
    stack, out, i = [], [], 0
    while i < len(text):
        if text.startswith(begin, i):
            stack.append(i)
        elif text.startswith(end, i) and stack:
            out.append((stack.pop(), i + 2))
        elif not text.startswith(end, i):
            i += 1
            continue
        i += 2
    return sorted(out)


def test_spans_equal_a_plain_stack():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["[[", "]]", "{{", "}}", "a", " é", "\n", "|", "x"]) for _ in range(rng.randint(0, 60)))
        found = tree.scan(text)
        for kind, begin, end in (("link", "[[", "]]"), ("template", "{{", "}}")):
            assert sorted((s["begin"], s["end"]) for s in found if s["kind"] == kind and s["state"] == "closed") == brute(text, begin, end)
        for s in found:
            assert s["line"] == text.count("\n", 0, s["begin"]) + 1 and s["col"] == s["begin"] - text.rfind("\n", 0, s["begin"])
            own = [t for t in found if t is not s and t["state"] == "closed" and t["begin"] <= s["begin"] and t["end"] >= s["end"]]
            parent = found[s["parent"]] if s["parent"] >= 0 else None
            assert (parent is None) == (not own) and (parent is None or parent["begin"] == max(t["begin"] for t in own))


def test_deep_and_long_texts_take_linear_time():
    deep = "{{a|" * 50 + "[[x]]" + "}}" * 50
    found = tree.scan(deep)
    assert all(s["state"] == "closed" for s in found) and max(s["depth"] for s in found) == 50
    for text in ("{{" * 500_000, "[[" * 500_000, "[[{{" * 250_000, "<!--" * 250_000, "<ref " * 200_000, "[[a|" * 250_000, "{{a\n" * 250_000, "{{" * 250_000 + "}}" * 250_000, "[[{{" * 120_000 + "]]}}" * 120_000):
        began = time.process_time()
        tree.repaired(text, ("link", "template"))
        assert time.process_time() - began < 20


def test_repair():
    cases = {
        "[[kota besar": "[[kota besar]]",
        "[[Berkas:a.jpg|x [[y]] z": "[[Berkas:a.jpg|x [[y]] z]]",
        "{{a|{{b}}": "{{a|{{b}}}}",
        "{{a|}} {{b|{{c}}": "{{a|}} {{b|{{c}}}}",
        "Lihat [[Indonesia untuk info.": "Lihat [[Indonesia]] untuk info.",
        "lebih]] dan }} sini": "lebih dan  sini",
        "[[a {{b]] c": "[[a {{b}}]] c",
        "{{Utama|Sejarah\nArtikel": "{{Utama|Sejarah}}\nArtikel",
        "{{Kotak\n| a = {{x\n|y}}\n| b = 1\nProsa": "{{Kotak\n| a = {{x\n|y}}\n| b = 1}}\nProsa",
        "<nowiki>[[a {{b</nowiki> <!-- [[ -->": "<nowiki>[[a {{b</nowiki> <!-- [[ -->",
        "": "",
    }
    for text, want in cases.items():
        got = tree.repaired(text, ("link", "template"))
        assert got == want and tree.repaired(got, ("link", "template")) == got
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["[[", "]]", "{{", "}}", "Nama ", "kata ", "|", "\n", ", "]) for _ in range(rng.randint(0, 40)))
        once = tree.repaired(text, ("link",))
        twice = tree.repaired(once, ("template",))
        assert not [s for s in tree.scan(twice) if s["state"] != "closed"], text


def test_findings_and_nulls(spark):
    rows = [(1, "satu\ndua [[tiga"), (2, None), (3, ""), (4, "a]] b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.state, r.line, r.col, r.excerpt) for r in tree.findings(docs, margin=4).collect()}
    assert got == {1: ("link", "open", 2, 5, "dua [[tiga"), 4: ("link", "stray", 1, 2, "a]] b")}
    assert [r.t for r in docs.orderBy("doc_id").select(tree.repair(F.col("text"), "link").alias("t")).collect()] == ["satu\ndua [[tiga]]", None, "", "a b"]
    assert [len(r.s) for r in docs.orderBy("doc_id").select(tree.spans("text").alias("s")).collect()] == [1, 0, 0, 1]


def test_places_in_prose_are_places_in_the_text(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["{{t|kata}}", "<ref>kata</ref>", "kata ", "é", "\n", "<nowiki>kata</nowiki>"]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = tree.found_in_prose(docs, "kata").collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.begin : r.end] == "kata" for r in found)
    assert len(found) == sum((t or "").count("kata ") for _, t in rows)


def test_around_equals_an_inequality_join(spark):
    rng = random.Random(1)
    points = [(rng.randint(0, 3), b, b + rng.randint(1, 3)) for b in (rng.randint(0, 5000) for _ in range(300))]
    intervals = [(rng.randint(0, 3), a, a + rng.choice([1, 5, 130, 4000, 70_000])) for a in (rng.randint(0, 5000) for _ in range(120))]
    p, q = spark.createDataFrame(points, "doc_id long, begin int, end int"), spark.createDataFrame(intervals, "doc_id long, `from` int, `to` int")
    got = sorted((r.doc_id, r.begin, r.end, r["from"], r.to) for r in tree.around(p, q).collect())
    assert got == sorted((d, b, e, f, t) for d, b, e in points for g, f, t in intervals if d == g and f <= b and e <= t)


def test_save_gate_counts_bags_in_linear_time(spark):
    pairs = [(1, 1, "Kota kota kota kota kota.", "kota lain di sana."), (2, 2, "Kota kota lain di sana.", "kota kota lain di sana."), (3, 3, None, "x"), (4, 4, "a b c d. " * 100_000, "a b c d. " * 100_000)]
    df = spark.createDataFrame(pairs, "source_id long, draft_id long, source_text string, draft_text string")
    began = time.perf_counter()
    got = {r.draft_id: (r.accepted, r.reasons) for r in reviews.save_gate(df).collect()}
    assert got == {1: (False, ["sentence lost"]), 2: (True, []), 3: (True, []), 4: (True, [])} and time.perf_counter() - began < 30
    kept = {r.draft_id: (r.n_sentences, r.n_lost) for r in reviews.retention(df).collect()}
    assert kept == {1: (1, 1), 2: (1, 0), 3: (0, 0), 4: (100_000, 0)}


def test_suite_repairs_on_the_tree(spark):
    df = spark.createDataFrame([("{{a|{{b}}",), ("[[kota besar",), ("{{a|" * 30 + "}}" * 30,)], "t string").select(rewrites.repair(F.col("t")).alias("r"), rewrites.syntax_issues(F.col("t")).alias("n"))
    assert [r.r for r in df.collect()] == ["{{a|{{b}}}}", "[[kota besar]]", "{{a|" * 30 + "}}" * 30] and df.collect()[2].n == []


def test_signs_and_nulls_outside_markup(spark):
    """Any sign may stand in a text, and null texts count as empty."""
    from corpusmill.operators import audits

    df = spark.createDataFrame([("a ␞ [[x,, y]] c,, d",), ("[[p,, q]]r,, s[[t]]",)], "t string")
    got = [r.o for r in df.select(rewrites.between(F.col("t"), rewrites.KEPT, lambda p: F.replace(p, F.lit(",,"), F.lit(","))).alias("o")).collect()]
    assert got == ["a ␞ [[x,, y]] c, d", "[[p,, q]]r, s[[t]]"]
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for made in (audits.qa_grade(docs), audits.doc_stats(docs)):
        one, two = (tuple(r)[1:] for r in made.orderBy("doc_id").collect())
        assert one == two and None not in one
    pairs = spark.createDataFrame([(1, 2, None, "x"), (2, 3, "1 2", None)], "source_id long, draft_id long, source_text string, draft_text string")
    assert [(r.missing_numbers, r.n_warnings) for r in reviews.factual_consistency(pairs).orderBy("source_id").collect()] == [(0, 0), (2, 1)]
