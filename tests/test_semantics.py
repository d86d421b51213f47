"""Sentence rules, gates and plans on small tables."""

import hashlib

from pyspark.sql import functions as F

from corpusmill.operators import semantics as S


def test_sentence_findings(spark):
    rows = [
        (1, "The king opposed the treaty.", "Raja mendukung perjanjian."),
        (2, "It might rain.", "Hujan pasti turun."),
        (3, "It lies to the southeast.", "Letaknya di tenggara."),
        (4, "They lie northeast.", "Di timur Laut."),
        (5, "Newton's law holds; today's news too.", "Hukum itu berlaku."),
        (6, "They declared him king.", "Mereka menobatkan dirinya."),
        (7, "They declared him king.", "Ia menobatkan dirinya sendiri."),
        (8, "He was found innocent.", "Ia tidak terbukti."),
    ]
    pairs = spark.createDataFrame(rows, "pair_id long, source string, draft string")
    f = S.sentence_findings(pairs)
    assert sorted((r.pair_id, r.rule) for r in f.collect()) == [(1, "polarity"), (2, "modality"), (4, "compass"), (5, "owner"), (6, "reflexive")]
    got = {r.pair_id: (r.score, r.passed) for r in S.scored(f, pairs, "pair_id").collect()}
    assert got[1] == (85, False) and got[2] == (90, False) and got[3] == (100, True)


def test_rules_and_rewrites(spark):
    docs = spark.createDataFrame([(1, "| kemudian presiden\nIa kemudian presiden {{x kemudian raja}} lalu\nKemudian raja"), (2, "")], "doc_id long, text string")
    found = S.rule_findings(docs, [("inversion", "medium", "\\bkemudian (?:presiden|raja)\\b")]).collect()
    assert sorted((r.doc_id, r.line, r.detail) for r in found) == [(1, 2, "kemudian presiden"), (1, 3, "Kemudian raja")]
    docs = spark.createDataFrame([(1, "suku Han di Qiang"), (2, "suku Han")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.guarded_rewrites(docs, [(["qiang"], "\\bsuku Han\\b", "suku Qiang Han")]).collect()}
    assert got == {1: "suku Qiang Han di Qiang", 2: "suku Han"}
    o = spark.createDataFrame([("apapun dan meskipun, pasca perang, non-Islam, anti Barat, sub-kategori",)], "t string").select(S.orthography(F.col("t")).alias("x")).first().x
    assert o == "apa pun dan meskipun, pascaperang, non-Islam, anti-Barat, subkategori"


def test_gate(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plans = spark.createDataFrame([("A", "x", sha("x"), "me", None), ("B", "x", sha("y"), None, None), ("C", "x", sha("x"), "me", 4), ("D", "x", sha("x"), "me", None)], "title string, content string, content_sha256 string, approved_by string, expected_revision long")
    live = spark.createDataFrame([("C", 5)], "title string, revision long")
    blockers = spark.createDataFrame([("D", "lint"), ("D", "lint"), ("D", "media")], "title string, reason string")
    got = {r.title: (r.approved, r.reasons) for r in S.publish_gate(plans, live, blockers).collect()}
    assert got == {"A": (True, []), "B": (False, ["content changed since approval", "not approved"]), "C": (False, ["target exists", "revision changed"]), "D": (False, ["lint", "media"])}


def test_category_plan(spark):
    src = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d"), ("c", "a")], "category string, member string")
    links = spark.createDataFrame([("a", "Alfa"), ("b", "Beta")], "member string, target string")
    dst = spark.createDataFrame([("c", "alfa"), ("c", "gamma")], "category string, member string")
    assert tuple(S.category_plan(src, links, dst).first()) == ("c", 3, 2, 1, ["Beta"], ["d"])


def test_reviews_fail_closed(spark):
    good = '{"complete": true, "claims": [{"source_quote": "one", "draft_quote": "satu", "status": "supported"}], "additions": []}'
    rows = [(1, "one two", "satu dua", good), (2, "two", "satu", good), (3, "one", "satu", "{broken"), (4, "one", "satu", good.replace("true", "false")), (5, "one", "satu", '{"complete": true, "claims": []}'), (6, "one", "satu", None)]
    got = {r.review_id: r.accepted for r in S.claim_review(spark.createDataFrame(rows, "review_id long, source string, draft string, answer string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_streams_fail_closed(spark):
    rows = [("a", 1, 'data: {"text": "He"}'), ("a", 3, 'data: {"text": "llo", "finish": "STOP"}'), ("a", 2, ": ping"), ("b", 1, 'data: {"text": "cut"}'), ("c", 1, "data: {oops"), ("c", 2, 'data: {"text": "x", "finish": "STOP"}')]
    got = {r.request_id: r.text for r in S.stream_text(spark.createDataFrame(rows, "request_id string, line_no int, line string")).collect()}
    assert got == {"a": "Hello", "b": "", "c": ""}
