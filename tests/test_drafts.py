"""Reviews, gates, drafts, mining, dictionary services, graphs and streamed folds on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audits, drafts, graph, ordered, reviews
from corpusmill.sources import tables


def pairs_of(spark, *rows):
    return spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(rows)], "source_id long, draft_id long, source_text string, draft_text string")


def test_gates_and_reviews(spark):
    before = "Pembuka.\n== Karier ==\nIa mendirikan koperasi baru. Ia memperjuangkan pendidikan perempuan.<ref>a</ref>"
    p = pairs_of(spark, (before, before), (before, "Pembuka.\n== Karier ==\nIa mendirikan koperasi baru.<ref>a</ref>"), (before, ""), (before, before.replace("== Karier ==\n", "")), (before, before.replace("<ref>a</ref>", "")), (None, None))
    got = {r.draft_id: list(r.reasons) for r in reviews.save_gate(p).collect()}
    assert got[0] == [] and got[1] == ["sentence lost"] and "empty" in got[2] and got[3] == ["heading lost"] and got[4] == ["reference lost"] and got[5] == ["empty"]
    r = reviews.review(pairs_of(spark, ("a b c", "Ia dilahirkan lalu dikebumikan di sana dengan praktek. [[Kategori:A]][[Kategori:B]]"), ("x", None))).orderBy("draft_id").collect()
    assert (r[0].n_fatal, r[0].n_typos, r[0].score, r[0].verdict) == (1, 1, 72, "rework") and r[1].n_reference_issues == 1 and r[1].score == 92
    f = reviews.factual_consistency(pairs_of(spark, ("In 1999 and 1999<ref>x</ref>", "Pada 1999"))).first()
    assert (f.missing_numbers, f.source_refs, f.draft_refs, f.n_warnings) == (1, 1, 0, 2)
    names = reviews.unanchored(pairs_of(spark, ("Anna met Robert Koch in Berlin.", "Lalu [[Robert Koch]] dan [[Louis Pasteur]] datang."))).collect()
    assert [x.name for x in names] == ["Louis Pasteur"]
    docs = spark.createDataFrame([(1, "kasih tahu gak\nnegara dependen itu"), (2, None)], "doc_id long, text string")
    assert [(r.n, r.score) for r in reviews.register_score(docs).orderBy("doc_id").collect()] == [(2, 94), (0, 100)]
    assert [(x.found, x.canonical) for x in reviews.title_anachronisms(docs).collect()] == [("negara dependen", "wilayah dependensi")]
    v = reviews.sorted_violations(spark.createDataFrame([(1, "b a\na [[a]] b")], "doc_id long, text string"), [("x", "low", "\\bb\\b"), ("r", "high", "\\ba\\b")]).first().violations
    assert [(x.line, x.rule) for x in v] == [(1, "r"), (1, "x"), (2, "r"), (2, "x")]
    g = spark.createDataFrame([("Setelah pulang ia tidur. Ia bukan menolak tetapi diam. {{x bukan menolak}}",)], "t string").select(reviews.grammar(F.col("t")).alias("o")).first().o
    assert g == "Setelah pulang, ia tidur. Ia tidak menolak, tetapi diam. {{x bukan menolak}}"
    pf = reviews.preflight(spark.createDataFrame([("P", "{{navbox x|a}} {{Film year category}} [[Category:Big one|k]]")], "title string, text string"), spark.createDataFrame([("P", "R")], "title string, category string"), ["navbox"]).first()
    assert (pf.templates, pf.categories, pf.rendered_categories, pf.header_templates) == (["Film year category", "Navbox x"], ["Big one"], ["R"], ["Film year category"])
    gaps = reviews.documentation_gaps(spark.createDataFrame([("T", "{{{a|}}} {{{b}}}", "| a = x\n| c = y"), ("U", "x", None)], "title string, text string, doc string"))
    assert {(r.title, r.issue) for r in gaps.collect()} == {("T", "undocumented: b"), ("T", "unknown: c"), ("T", "no TemplateData"), ("U", "no documentation"), ("U", "no TemplateData")}


def test_articles_and_boxes(spark):
    page = "{{Infobox film\n| name = X\n}}\n'''X''' adalah film.\n\n== Filmography ==\n* A\n\n== External links ==\n* [https://x y]\n{{X navbox}}"
    out = drafts.stubs(spark.createDataFrame([("X (film)", page), ("E", "")], "title string, text string"), spark.createDataFrame([("X (film)", "X (film lokal)")], "source string, local string"), spark.createDataFrame([("X navbox",)], "template string"), [("film", "film-stub")])
    got = {r.source: r for r in out.collect()}
    assert got["X (film)"].title == "X (film lokal)" and got["X (film)"].accepted and not got["E"].accepted
    assert got["X (film)"].content.startswith("{{Infobox film") and got["X (film)"].content.endswith("{{X navbox}}\n\n{{film-stub}}") and "== Karya ==\n* A" in got["X (film)"].content
    t = drafts.table_cells(spark.createDataFrame([(1, "{| x\n! Year !! Title\n|-\n| 1999 || Yes\n|}\nYes")], "doc_id long, text string")).first().text
    assert t == "{| x\n! Tahun !! Judul\n|-\n| 1999 || Ya\n|}\nYes"
    n = drafts.navboxes(spark.createDataFrame([("N", "{{Navbox\n| name = N\n| title = [[Moscow]]\n| list1 = [[Paris]] and x\n}}")], "title string, text string"), spark.createDataFrame([("Moscow", "Moskwa")], "target string, mapped string")).first().content
    assert n == "{{Navbox\n| nama = N\n| judul = [[Moskwa]]\n| daftar1 = [[Paris]] and x\n}}"
    tp = drafts.template_pages(spark.createDataFrame([("Template:box", "{{{name|}}} {{{x}}}<noinclude>doc</noinclude>")], "title string, text string")).first()
    assert tp.title == "Templat:Box" and tp.content == "{{{nama|{{{name|}}}|}}} {{{x}}}<noinclude>\n{{Dokumentasi}}\n</noinclude>".replace("|}}}|}}}", "|}}}|}}}") and '"label":"nama"' in tp.template_data


def test_categories_and_evidence(spark):
    names = spark.createDataFrame([(c,) for c in ("a", "b", "1990s films", "d", "e")], "category string")
    t = lambda *rows: spark.createDataFrame(list(rows), "category string, mapped string")
    exists = spark.createDataFrame([("LB",), ("Film 1990-an",), ("SD",)], "title string")
    out = drafts.resolved_categories(names, t(("a", "CA")), t(("b", "LB"), ("d", "none there")), exists, [("^([0-9]{4})s films$", "Film tahun $1-an")], t(("d", "SD")))
    assert {r.category: (r.mapped, r.origin) for r in out.collect()} == {"a": ("CA", "cache"), "b": ("LB", "langlink"), "1990s films": ("Film 1990-an", "variation"), "d": ("SD", "sitelink"), "e": ("e", "unresolved")}
    rep = drafts.replicated_categories(t(("P", "A")).toDF("title", "category"), t(("P", "A"), ("P", "B")).toDF("title", "category"), t(("B", "Be")))
    assert {tuple(r) for r in rep.collect()} == {("P", "A", None, "explicit"), ("P", "B", "Be", "rendered")}
    p = drafts.promotion(spark.createDataFrame([("a", "ok"), ("b", "Lua error in x"), ("c", None), ("d", '<strong class="error">'), ("e", "[[open")], "title string, html string"))
    assert {r.title: r.reason for r in p.collect()} == {"a": None, "b": "Lua error", "c": "nothing rendered", "d": "error", "e": "unclosed markup"}
    edges = spark.createDataFrame([("x", "y"), ("y", "z")], "src string, dst string")
    sync = drafts.ecosystem_sync(spark.createDataFrame([(0, "z"), (1, "y"), (2, "x")], "place int, node string"), spark.createDataFrame([("z", "ok"), ("y", None), ("x", "ok")], "title string, html string"), edges)
    assert {r.node: r.status for r in sync.collect()} == {"z": "promoted", "y": "failed", "x": "blocked"}
    g = drafts.prompt_glossary([t(("a", "1"), ("b", "1")).selectExpr("'t' topic", "category term", "mapped target"), t(("b", "2")).selectExpr("'t' topic", "category term", "mapped target")], spark.createDataFrame([("t", "x"), ("t", "y"), ("t", "z")], "topic string, text string")).first().content
    assert g == "a = 1\nb = 2\n\nx\n---\ny"
    assert "Kesalahan fatal: 2" in drafts.review_letter(spark.createDataFrame([(1, 50, "rework", 2, 0, 0, 0)], "draft_id long, score int, verdict string, n_fatal int, n_calques int, n_typos int, n_reference_issues int")).first().content
    assert drafts.snapshot(spark.createDataFrame([("T", "Paris")], "title string, content string"), "r").first().n_chars == 5
    rep = drafts.session_report(spark.createDataFrame([("a", "link", "x", 2), ("a", "link", "y", 1), ("a", "link", "x", 3)], "article string, category string, item string, ts int")).first()
    assert (rep.n, rep["items"]) == (2, ["y", "x"])
    plan = drafts.write_plan("edit", spark.createDataFrame([("T", None)], "t string, c string"), F.col("t"), F.col("c")).first()
    assert plan.kind == "edit" and plan.content is None and plan.content_sha256.startswith("e3b0c4")
    assert "artikel = A" in drafts.rationale(spark.createDataFrame([("f", "A", None, None)], "file string, article string, source string, author string")).first().content


def test_dictionary_and_mining(spark):
    js = [("a", '{"class": "n", "definition": [{"text": "first"}], "synonyms": ["x", "y"]}'), ("b", '{"definition": "plain", "synonyms": "p, q"}'), ("c", "{}")]
    out = {r.lemma: r for r in drafts.dictionary_entries(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "lemma string"), spark.createDataFrame(js, "lemma string, json string")).collect()}
    assert (out["a"].definition, out["a"].synonyms, out["b"].definition, out["b"].synonyms, out["c"].synonyms, out["d"].found) == ("first", ["x", "y"], "plain", ["p", "q"], [], False)
    k = spark.createDataFrame([("t", "Pasca", "x"), ("t", "y", "PASCA-z"), ("t", "q", "q")], "topic string, term string, value string")
    assert drafts.knowledge_search(k, "pasca").count() == 2
    m = spark.createDataFrame([("t", "a", 1, 1), (None, "b", 5, 1), ("u", "c", 9, 1), ("t", "d", 5, 2)], "topic string, term string, usage_count int, updated_at int")
    assert [r.term for r in drafts.for_topic(m, "t").collect()] == ["d", "b", "a"] and {r.term for r in drafts.without_topic(m, "t").collect()} == {"b", "c"}
    o = drafts.ranked_options(spark.createDataFrame([("Mercury", "planet closest orbit"), ("Java", "island island")], "title string, context string"), spark.createDataFrame([("Mercury", "Mercury (planet)", "closest orbit of all"), ("Mercury", "Mercury (element)", "metal orbit"), ("Java", "Java (island)", "x")], "title string, option string, description string"))
    assert [(r.title, r.option, r.score) for r in o.collect()] == [("Mercury", "Mercury (planet)", 3.0)]
    s = drafts.subsets(spark.createDataFrame([("p", ["a", "b"]), ("q", ["z"]), ("e", [])], "key string, items array<string>"), spark.createDataFrame([("r", ["a", "b", "c"]), ("s", ["b"])], "key string, items array<string>"))
    assert [tuple(r) for r in s.collect()] == [("p", "r")]
    th = drafts.thread_terms(spark.createDataFrame([(1, "aktivitas vs. aktifitas", "yang baku aktifitas"), (2, "Salam", "usulan \"kata baru\"")], "thread_id long, title string, text string")).collect()
    assert [(r.term, r.target, r.family) for r in th] == [("aktivitas", "aktifitas", "versus")]
    assert [r.title for r in drafts.archive_pages(spark.createDataFrame([("Arsip/%d",)], "pattern string"), 2008, 2010).orderBy("year").collect()] == ["Arsip/2008", "Arsip/2009", "Arsip/2010"]
    c = spark.createDataFrame([("PRAKTEK praktek Praktek [[praktek]]",)], "t string").select(drafts.case_kept_fixes("t", [("praktek", "praktik")]).alias("o")).first().o
    assert c == "PRAKTIK praktik Praktik [[praktek]]"


def test_orders_and_transactions(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("z", "y"), ("y", "z"), ("a", "a")], "src string, dst string")
    assert [r.node for r in graph.ordered_names(e).orderBy("place").collect()] == ["a", "b", "c", "d", "y", "z"]
    with pytest.raises(ValueError):
        graph.ordered_names(e, most=2)
    with pytest.raises(ValueError):
        graph.refuse_flattening(2)
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(45)], "src string, dst string")
    assert {r.node: r.level for r in graph.levels(chain).collect()} == {f"n{i:03}": 45 - i for i in range(46)}
    nodes = spark.createDataFrame([(i, n) for i, n in enumerate("abcde")], "place int, node string")
    journal, reused = spark.createDataFrame([("a", "published")], "node string, status string"), spark.createDataFrame([("b",)], "node string")
    called = []
    out = graph.transaction(nodes, lambda n: called.append(n) or n != "d", journal, reused)
    assert [r.status for r in out.orderBy("place").collect()] == ["skipped", "reused", "published", "failed", "planned"] and called == ["c", "d"]
    d = graph.deployment(spark.createDataFrame([("x", "y")], "src string, dst string"), nodes, spark.createDataFrame([("y",)], "node string"), spark.createDataFrame([("y", "drafted")], "node string, status string"))
    assert {r.node: r.status for r in d.collect()}["x"] == "deployed"


def test_predecessors_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(audits, "RANGE", 10)
    rng = random.Random(2)
    ids = rng.sample(range(500), 120)
    rows = [(f"s{i % 3}", i) for i in ids]
    want = set()
    for s in ("s0", "s1", "s2"):
        own = sorted(i for x, i in rows if x == s)
        want |= set(zip(own, own[1:], strict=False))
    assert {tuple(r) for r in audits.predecessors(spark.createDataFrame(rows, "source string, doc_id long")).collect()} == want


def test_streamed_folds(spark):
    rows = [("g", i, "t", s) for i, s in ((0, 1), (3, 1), (12, 1), (14, 2), (30, 2))]
    df = spark.createDataFrame(rows, "doc string, pos long, target string, section int")
    keep = {r.pos: r.keep for r in ordered.unlink_repeats(df, "doc", "pos", "target", 10).collect()}
    assert keep == {0: True, 3: False, 12: True, 14: False, 30: True}
    keep = {r.pos: r.keep for r in ordered.unlink_repeats(df, "doc", "pos", "target", 10, reset="section").collect()}
    assert keep == {0: True, 3: False, 12: True, 14: True, 30: True}
    packs = ordered.greedy_pack(spark.createDataFrame([("g", i, n) for i, n in enumerate([100, 100, 100, 300, None, 10])], "g string, i int, n long"), "g", "i", "n", 250)
    assert {r.i: r["pack"] for r in packs.collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}
    c = ordered.bounded_context(spark.createDataFrame([("g", i, f"w{i} " * 100) for i in range(3)], "g string, i int, t string"), "g", "i", "t", 2, 150).orderBy("i").collect()
    assert [len(r.context.split()) for r in c] == [0, 100, 150] and c[2].context.startswith("w0 w0")


def test_sources(spark, tmp_path):
    (tmp_path / "k").mkdir()
    for i, t in enumerate(['{"topic": {"a": "b"}}', '{"x": "y"}', '[{"term": "p", "value": "q"}]', "{broken"]):
        (tmp_path / "k" / f"{i}.json").write_text(t)
    assert {tuple(r) for r in tables.read_knowledge(spark, str(tmp_path / "k")).collect()} == {("topic", "a", "b"), (None, "x", "y"), (None, "p", "q")}
    assert tables.read_knowledge(spark, str(tmp_path / "none")).count() == 0
    out = tables.fetch_pages(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "title string"), spark.createDataFrame([("A", "a", None), ("B2", "b", False), ("C", "c", True)], "title string, text string, disambiguation boolean"), spark.createDataFrame([("B", "B2")], "title string, target string"))
    assert {r.title: (r.status, r.text) for r in out.collect()} == {"A": ("ok", "a"), "B": ("redirected", "b"), "C": ("disambiguation", None), "D": ("missing", None)}
    tables.write_lexicon(spark.createDataFrame([("t", "a", "b"), ("t", "c", "d")], "topic string, term string, target string"), str(tmp_path / "lex"))
    assert spark.read.json(str(tmp_path / "lex")).count() == 1


def test_attribution_links_and_escalation(spark):
    p = pairs_of(
        spark,
        ('[[Anna Frey]] wrote: "it was so." It was directed by [[Lev Ilin]].', 'Boris Kant menulis: "begitu." Film disutradarai oleh [[Olga Ro]].'),
        ("See [[Paris]] and [[New York]] and [[New York City]].", "Di New York City dan Paris, lalu Paris lagi; [[Roma|Paris]]."),
        ("One long sentence stands here now.", "Kalimat panjang ini ada disini. Selamanya dikenang sebagai pahlawan besar bangsa kita tercinta."),
    )
    assert {(r.draft_id, r.kind, r.name) for r in reviews.attribution(p).collect()} == {(0, "speaker", "Boris Kant"), (0, "director", "Olga Ro")}
    got = {r.draft_id: (r.text, r.n) for r in reviews.relinked(p).collect()}
    assert got[1] == ("Di [[New York City]] dan [[Paris]], lalu Paris lagi; [[Roma|Paris]].", 3) or got[1][0] == "Di [[New York City]] dan [[Paris]], lalu Paris lagi; [[Roma|Paris]]."
    assert [(r.draft_id, r.sentence[:10]) for r in reviews.unanchored_sentences(p).collect()] == [(2, "Selamanya ")]
    e = reviews.escalation(spark.createDataFrame([(1, 90, 0, 50, 300), (2, 50, 3, 300, 300), (3, 90, 0, 10, 100)], "draft_id long, score int, n_fatal int, n_draft int, n_source int"))
    assert {r.draft_id: list(r.reasons) for r in e.collect()} == {1: ["incomplete"], 2: ["low score", "fatal findings"], 3: []}


def test_hooks_and_cache(spark):
    out = drafts.translated(spark.createDataFrame([(1, "a"), (2, None)], "i int, content string"), lambda s: s.str.upper())
    assert {r.i: r.draft for r in out.collect()} == {1: "A", 2: None}
    t = lambda q, s: spark.sql(f"SELECT * FROM VALUES {q} AS t({s})")
    cache = t("('a', '1', timestamp'2024-01-20'), ('b', '2', timestamp'2023-01-01'), ('c', '3', timestamp'2023-01-01')", "lemma, json, updated_at")
    out = drafts.cached_entries(spark.createDataFrame([(x,) for x in "abcd"], "lemma string"), cache, t("('a', '9'), ('b', '8')", "lemma, json"), F.expr("timestamp'2024-02-01'"))
    assert {r.lemma: (r.json, r.origin) for r in out.collect()} == {"a": ("1", "fresh"), "b": ("8", "live"), "c": ("3", "stale"), "d": (None, "none")}


def test_quality_layers(spark):
    good = "Ia lahir pada 1990 di kota.<ref>a</ref> Lalu pindah ke desa. {{reflist}} [[Kategori:A]] [[Kategori:B]]"
    p = pairs_of(spark, (good, good), (good, "Ia gak lahir. Ia pergi praktek. Ia [[pulang"), (good, None), (good, good + " Tokoh dilahirkan dan dikebumikan di sana."))
    got = {r.draft_id: r for r in reviews.quality_layers(p).collect()}
    assert (got[0].draft, got[0].language, got[0].technique, got[0].grade, got[0].approved) == (100, 100, 100, "A++", True)
    # 7 of 18 words, one number and the reference lost; one plain word, two openers in a row, one misspelling; one open link, no categories
    assert (got[1].draft, got[1].language, got[1].technique) == (55, 94, 80) and got[1].total == int(55 * 0.25 + 94 * 0.45 + 80 * 0.3)
    assert got[2].critical and got[2].total <= 65 and not got[2].approved
    assert got[3].critical and got[3].total == 65 and got[3].grade == "C"
