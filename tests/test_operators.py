"""Operators on small tables written for them."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audits, graph, localise, markup, ordered, resolve
from corpusmill.sources import tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.estimate_tokens("t"), t="") == 1
    assert one(spark, T.estimate_tokens("t"), t="x" * 19) == 5
    assert one(spark, T.title("t"), t=" film_of  the year") == "Film of the year"
    assert one(spark, T.slug("t"), t=" The Big-City: Part 2! ") == "the-big-city-part-2"
    assert one(spark, T.sentences("t"), t="It rose by 3.5 percent. Yes. A second one here! And now\na third one?") == ["It rose by 3.5 percent.", "A second one here!", "And now a third one?"]
    assert one(spark, T.copy_case("a", "b"), a="FILM", b="kata") == "KATA"
    assert one(spark, T.copy_case("a", "b"), a="Film", b="kata") == "Kata"
    assert one(spark, T.copy_case("a", "b"), a="film", b="kata") == "kata"
    assert one(spark, T.line_number("t", F.lit(5)), t="a\nb\ncd") == 3
    assert one(spark, T.visible("t"), t="<p>a &amp; b</p><script>x<y</script> c") == "a & b c"
    assert one(spark, T.script_language("t"), t="Привет") == "ru"


def test_lint(spark):
    docs = spark.createDataFrame([(1, "A clean line."), (2, "BAD!! text ### mail a.b@c.org  here"), (3, "")], "doc_id long, text string")
    v = {(r.doc_id, r.rule): r.n for r in audits.violations(docs).collect()}
    assert v == {(2, "repeated_mark"): 1, (2, "symbol_run"): 1, (2, "mail_address"): 1, (2, "double_space"): 1}
    assert {r.doc_id: (r.score, r.verdict) for r in audits.lint_score(docs).collect()} == {1: (100, "clean"), 2: (100 - 6 - 12 - 12 - 3, "review"), 3: (100, "clean")}


def pair(spark, a, b):
    return spark.createDataFrame([(1, 2, a, b)], "source_id long, draft_id long, source_text string, draft_text string")


def test_numbers_are_used_up(spark):
    got = {r.number: r.missing for r in audits.missing_numbers(pair(spark, "7 and 7 and 1,250 in 1999", "7 in 1999")).collect()}
    assert got == {"7": 1, "1,250": 1}


def test_gates(spark):
    long = "word " * 100
    assert audits.section_gate(pair(spark, long, "")).first().reason == "empty"
    assert audits.section_gate(pair(spark, long, "too short")).first().reason == "short"
    assert audits.section_gate(pair(spark, long + "111 222 333 444", long)).first().reason == "numbers"
    r = audits.lexical_retention(pair(spark, "a a b c", "a b")).first()
    assert (r.n_source, r.n_kept, r.passed) == (4, 2, False)
    e = audits.entity_grounding(pair(spark, "Old Town met Bob", "Bob met New Town")).first()
    assert (e.dropped, e.phantom) == (1, 1)


def test_alignment_rounds_half_to_even(spark):
    s = "One two three. " * 4
    got = {r.i: r.j for r in audits.aligned_sentences(pair(spark, s, "One two three. " * 2)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_priority_orders_differ(spark):
    g = spark.createDataFrame([("t", "a", "custom"), ("t", "b", "consensus"), ("u", "z", "remote"), ("u", "y", "remote"), ("v", "q", "elsewhere"), ("v", "r", "remote")], "term string, target string, source string")
    t = spark.createDataFrame([("t",), ("u",), ("v",), ("w",)], "term string")
    assert {r.term: r.target for r in resolve.first_match(t, g, resolve.TERM_ORDER).collect()} == {"t": "a", "u": "y", "v": "r", "w": None}
    assert {r.term: r.target for r in resolve.first_match(t, g, resolve.SECTION_ORDER).collect()}["t"] == "b"


def test_set_diff_and_terms(spark):
    a = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "z")], "g string, m string")
    b = spark.createDataFrame([("g", "y"), ("g", "w")], "g string, m string")
    assert {r.g: (r.existing, r.missing, r.extra) for r in resolve.set_diff(a, b, "g", "m").collect()} == {"g": (1, 1, 1), "h": (0, 1, 0)}
    t = spark.createDataFrame([(1, "Old Town"), (1, "Town"), (1, "Old Town Hall"), (1, "Townsend"), (2, "Town")], "doc_id long, term string")
    assert {(r.doc_id, r.term) for r in resolve.longest_only(t).collect()} == {(1, "Old Town Hall"), (1, "Townsend"), (2, "Town")}
    d = spark.createDataFrame([(1, "The old man and the sea. The old!")], "doc_id long, text string")
    p = spark.createDataFrame([("the old",), ("the old man",), ("sea",)], "phrase string")
    assert {(r.phrase, r.n) for r in resolve.phrase_mentions(d, p).collect()} == {("the old", 2), ("the old man", 1), ("sea", 1)}


def test_fuzzy(spark):
    a = spark.createDataFrame([("Stephenson",), ("London",)], "a string")
    b = spark.createDataFrame([("Stephensen",), ("Londonderry",), ("Paris",)], "b string")
    assert [(r.a, r.b) for r in resolve.fuzzy_match(a, b).collect()] == [("Stephenson", "Stephensen")]


def _equivalent(a, b):
    """All pairs by brute force: ratio, words inside, exonyms, stems."""
    e, f = a.strip().casefold(), b.strip().casefold()
    t, u = ({w for w in re.findall(r"\w+", x) if len(w) > 2} for x in (e, f))
    if e == f or (t and u and (t <= u or u <= t)) or (e, f) in resolve.EXONYMS or (f, e) in resolve.EXONYMS or SequenceMatcher(None, e, f).ratio() >= 0.82:
        return True
    r, s = ([resolve.stem(w) for w in re.findall(r"\w+", x) if len(w) > 3] for x in (e, f))
    return any(p == q or (len(p) >= 4 and len(q) >= 4 and (p.startswith(q) or q.startswith(p))) for p in r for q in s)


def test_fuzzy_loses_no_pair(spark):
    rng = random.Random(3)
    a = ["Jakarta", "Mohammed", "Johannes", "Bo", "Al", "Russian Empire", "Bank of England", "Democracy", "The Hague", "Philosophy", "Ann", "straße", "Buruh", "Old The", "ISME"]
    b = ["Djakarta", "Muhammed", "Yohannes", "BO", "Ali", "Kekaisaran Rusia", "England", "Demokrasi", "Hague", "Filosofi", "Anne", "STRASSE", "Blue-collar worker", "The", "Tion"]
    a += ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in range(120)]
    for w in a[-120:]:
        w = list(w)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "e"])
        b.append("".join(w))
    x, y = spark.createDataFrame([(n,) for n in [*a, None]], "a string"), spark.createDataFrame([(n,) for n in [*b, None]], "b string")
    alike = {(p, q): SequenceMatcher(None, p.strip().casefold(), q.strip().casefold()).ratio() for p in a for q in b}
    got = resolve.fuzzy_match(x, y).collect()
    assert {(r.a, r.b): r.ratio for r in got} == {k: v for k, v in alike.items() if v >= 0.82} and len({(r.a, r.b) for r in got}) == len(got)
    got = resolve.same_entity(x, y).collect()
    assert {(r.a, r.b): r.ratio for r in got} == {k: v for k, v in alike.items() if _equivalent(*k)} and len({(r.a, r.b) for r in got}) == len(got)


def test_packing_starts_again(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([100, 100, 100, 400, 10, 240, 1])], "g string, k int, n int")
    assert [r.pack for r in ordered.greedy_pack(df, "g", "k", "n", 250).orderBy("k").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_unlinking_keeps_the_clock_of_kept_links(spark):
    df = spark.createDataFrame([("d", p, "T") for p in (1, 3, 5, 7)] + [("d", 2, "U")], "d string, p int, t string")
    got = {(r.t, r.p): r.keep for r in ordered.unlink_repeats(df, "d", "p", "t", 3).collect()}
    assert got == {("T", 1): True, ("T", 3): False, ("T", 5): True, ("T", 7): False, ("U", 2): True}


def test_latest_and_upsert(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, ts int, v string")
    c = spark.createDataFrame([("a", 2, "z"), ("b", 4, "old"), ("c", 1, "n")], "k string, ts int, v string")
    assert {r.k: r.v for r in ordered.upsert(s, c, ["k"], "ts").collect()} == {"a": "z", "b": "y", "c": "n"}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("w", "x"), ("a", "a")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.level for r in graph.closure(e, root).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.node for r in graph.closure(e, root, 1).collect()} == {"a", "b", "c"}
    assert {r.node: r.n for r in graph.revisits(e, root).collect()} == {"d": 2}
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"e": 0, "d": 1, "b": 2, "c": 2, "a": 3, "x": -1, "y": -1, "w": -1}
    none = spark.createDataFrame([("d",)], "node string")
    got = {r.node: r.status for r in graph.deployment(e, root, none).collect()}
    assert {k for k, v in got.items() if v == "blocked"} == {"a", "b", "c", "d"} and got["e"] == "deployed"


WIKI = """Lead [[Paris|city]] text<ref name="a">one</ref>.
<!-- == not a heading == -->
== First ==
Some words here <ref name="a">two</ref>.

More words in a second paragraph.
=== Sub ===
{{cite web|url=http://x.org/1|title=T}} and <math>x^2</math> {{Main|Thing}}
"""


def test_markup(spark):
    d = spark.createDataFrame([(1, WIKI), (2, None), (3, "a [[b {{c}} d]] }} {{ e")], "doc_id long, text string")
    s = markup.sections(d).filter("doc_id = 1").orderBy("idx").collect()
    assert [(r.title, r.level) for r in s] == [("", 0), ("First", 2), ("Sub", 3)]
    c = markup.chunks(markup.sections(d).filter("doc_id = 1 AND idx = 1"), 6).orderBy("pos").collect()
    assert [r.chunk for r in c] == [0, 1]
    assert {(r.doc_id, r.kind): (r.unclosed, r.stray) for r in markup.balance(d).collect()} == {(3, "template"): (1, 1)}
    x = markup.compress(d)
    assert "cite web" not in x.filter("doc_id = 1").first().compressed
    damaged = x.withColumn("compressed", F.regexp_replace("compressed", "⟦(\\w+)⟧", "[$1]"))
    for back in (markup.restore(x), markup.restore(damaged)):
        assert back.filter("doc_id = 1").first().restored == WIKI
    assert [(r.target, r.label) for r in markup.links(d).filter("doc_id = 1").collect()] == [("Paris", "city")]
    m = spark.createDataFrame([("Paris", "Lutetia")], "target string, mapped string")
    assert "[[Lutetia|city]]" in markup.map_links(d, m).filter("doc_id = 1").first().text
    assert [(r.name, r.n, r.first) for r in markup.named_references(d).collect()] == [("a", 2, "one")]


def test_localise(spark):
    assert one(spark, localise.currency("t"), t="$50 million, £10 million and $50K") == "US$50 juta, £10 juta and US$50 ribu"
    assert one(spark, localise.currency("t"), t="[[File:$5 million]] €5 million") == "[[File:$5 million]] €5 juta"
    assert one(spark, localise.units("t"), t="50 miles, 50 ft, 50 lbs, 50 square miles") == "50 mil, 50 kaki, 50 pon, 50 mil persegi"
    assert one(spark, localise.metric_first("t"), t="100 miles (160 km), 5 ft 10 in (178 cm)") == "160 km (100 mil), 178 cm (5 kaki 10 inci)"
    assert one(spark, localise.templates("t", ["Kotak"]), t="{{Main|A}} {{Kotak}} {{Navbox x|y}}") == "{{Utama|A}} {{Kotak}} <!-- Templat belum tersedia di id.wiki: {{Navbox x|y}} -->"
    p = spark.createDataFrame([("A b", "film", 12), ("C", None, 3)], "title string, topic string, revision long")
    assert {r.title: r.content for r in localise.attribution(p).collect()} == {"A b": "{{Diterjemahkan dari|en|A_b|version=12}}\n{{ProyekWiki Film}}", "C": "{{Diterjemahkan dari|en|C|version=3}}"}
    r = spark.createDataFrame([("The City", "Kota – lama (film)")], "source string, target string")
    assert {(x.title, x.reason) for x in localise.redirects(r).collect()} == {("The City", "english_name"), ("Kota - lama (film)", "punctuation"), ("Kota – lama", "without_disambiguator")}
    d = spark.createDataFrame([(1, WIKI)], "doc_id long, text string")
    assert [x.url for x in localise.missing_archives(d).collect()] == ["http://x.org/1"]
    a = spark.createDataFrame([("http://x.org/1", "http://arch/1", "2024-01-01")], "url string, archive_url string, archive_date string")
    assert "|archive-url=http://arch/1 |archive-date=2024-01-01 |url-status=live}}" in localise.inject_archives(d, a).first().text
    log = spark.createDataFrame([("t", "x", "propose", 1), ("t", "x", "use", 2), ("t", "x", "approve", 3), ("t", "x", "use", 9)], "term string, target string, action string, ts int")
    s = localise.term_state(log).first()
    assert (s.status, s.usage_count, s.created_at, s.updated_at) == ("approve", 2, 1, 9)
    th = spark.createDataFrame([(1, "* ''rail gauge'' = lebar sepur\nnoise\n"), (2, "rail gauge → lebar rel")], "thread_id long, text string")
    assert [(x.term, x.target) for x in localise.mine_pairs(th).collect()] == [("rail gauge", "lebar rel")]


def test_sources(spark, tmp_path):
    q = str(tmp_path / "q")
    tables.write_queue(spark.createDataFrame([("B",), ("A",)], "title string"), q, "two titles")
    assert Counter(r.title for r in tables.read_queue(spark, q).collect()) == {"A": 1, "B": 1}
    j = str(tmp_path / "j")
    tables.append_journal(spark.createDataFrame([("n", "ok")], "node string, status string"), j)
    (tmp_path / "j" / "bad.json").write_text("{not json\n")
    assert [r.status for r in tables.read_journal(spark, j, "node string, status string").collect()] == ["ok"]
    (tmp_path / "k.json").write_text('{"topic": {"a": "b", "c": "d"}}')
    assert {(r.topic, r.term, r.value) for r in tables.read_knowledge(spark, str(tmp_path / "k.json")).collect()} == {("topic", "a", "b"), ("topic", "c", "d")}
