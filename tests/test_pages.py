"""Page sets and parts on small tables."""

from pyspark.sql import functions as F

from corpusmill.operators import markup, pages


def test_members_backlinks_search(spark):
    e = spark.createDataFrame([("C", "a", 0), ("C", "S", 14), ("C", "a", 0), ("D", "b", 0)], "category string, member string, ns int")
    assert [r.title for r in pages.members(e, "C").collect()] == ["a"] and [r.title for r in pages.members(e, "C", True).collect()] == ["S"]
    l = spark.createDataFrame([("x", "T", 0), ("y", "T", 0), ("u", "T", 2), ("z", "U", 0)], "src string, dst string, ns int")
    t = spark.createDataFrame([("y", "T", 0), ("w", "T", 0)], "src string, dst string, ns int")
    assert sorted(tuple(r) for r in pages.backlinks(l, t, "T").collect()) == [("w", "transclusion"), ("x", "link"), ("y", "link")]
    assert [r.title for r in pages.backlinks(l, t, "T", 2).collect()] == ["w", "x"]
    p = spark.createDataFrame([("A", "The red House"), ("B", "a red car"), ("C", None)], "title string, text string")
    assert [r.title for r in pages.search(p, ["house", "RED"]).collect()] == ["A"]
    assert sorted(r.title for r in pages.missing_pages(p, spark.createDataFrame([("A",)], "title string")).collect()) == ["B", "C"]


def test_disambiguation(spark):
    rows = [("A", None, None, False), ("A (disambiguation)", None, None, True), ("B", ["Disambiguation pages"], None, True), ("C", ["Films"], True, True)]
    df = spark.createDataFrame(rows, "t string, c array<string>, m boolean, want boolean")
    assert df.filter(pages.is_disambiguation(F.col("t"), F.col("c"), F.col("m")) != F.col("want")).count() == 0


def test_media_and_infobox(spark):
    d = spark.createDataFrame([(1, "{{Infobox film\n| name = X\n| image = poster_a.jpg\n| starring = Y | Z\n}}\n[[File: Map b.png|thumb]] [[Image:gone.svg]]")], "doc_id long, text string")
    one = lambda x: spark.createDataFrame([(x,)], "file string")
    got = {r.file: r.status for r in pages.media_status(pages.media(d), one("Map b.png"), one("none"), one("Poster a.jpg")).collect()}
    assert got == {"Map b.png": "commons", "Poster a.jpg": "nonfree", "Gone.svg": "missing"}
    p = pages.infobox_parameters(d)
    assert [(r.name, r.value) for r in p.orderBy("pos").collect()] == [("name", "X"), ("image", "poster_a.jpg"), ("starring", "Y | Z")]
    m = spark.createDataFrame([("film", "name", "nama"), ("film", "starring", "a"), ("film", "starring", "b")], "box string, name string, new string")
    assert {r.name for r in pages.map_parameters(p, m).collect()} == {"nama", "image", "starring"}


def test_revisions_references_appendix(spark):
    p = spark.createDataFrame([(1, "the rail gauge was wide", "the lebar sepur was wide"), (2, None, "x")], "pair_id long, before string, after string")
    assert [(r.source_term, r.target_term, r.confidence) for r in pages.changed_terms(p).collect()] == [("rail gauge", "lebar sepur", 0.8)]
    d = spark.createDataFrame([(1, '<ref name="a">x</ref> <ref name="a"/> <ref name="b" /> \n== Notes ==\nn\n== See also ==\ns\n== Body ==\nb\n')], "doc_id long, text string")
    assert [(r.doc_id, r.name) for r in pages.orphan_references(d).collect()] == [(1, "b")]
    s = pages.appendix_order(markup.sections(d), ["See also", "Notes"])
    assert [r.title for r in s.orderBy("new_idx").collect()] == ["", "Body", "See also", "Notes"]
