"""Cases of the findings of round 4."""

import heapq
import random
import re

import duckdb
from pyspark.sql import functions as F

from corpusmill.operators import dictionary, graph, rewrites
from corpusmill.plans import catalogue, markup  # noqa: F401  the second adds its queries


def test_currency_and_units_equal_their_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(7)
    bits = ["$5 million", "$5M", "£1.5B", "5 in", "6 ft", "7 square miles", "3 inches", "9 lbs", "12 mi", "in", "ú", "é", "́", "_", " ", " ", ",", "$", "[[", "]]", "{{", "}}", "<ref>", "</ref>", "<code>", "</code>", "\n", "﷐", "␞", "½", "1,2", "км", "x"]
    texts = [None, "", "12 inútil, 5 in 6 in 7 in", "[[5 miles]] 5 miles {{a|$5 million}}", "é5 in; $5M$6M $7Mé", "5 in﷐[[6 in]] 7 in", *("".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(2000))]
    folder = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = dict(con.execute(catalogue.ORACLES["currency_and_units"]).fetchall())
    got = {r.doc_id: r.text_sha256 for r in catalogue.QUERIES["currency_and_units"](spark, folder).collect()}
    assert [texts[i] for i in sorted(want) if want[i] != got[i]] == [] and len(got) == len(texts)


def test_ordered_names_of_more_links_than_a_deployment_has(spark):
    n = 130_000
    e = spark.range(1, n).selectExpr("concat('n', id) AS src", "concat('n', id div 2) AS dst").union(spark.createDataFrame([("x", "y"), ("y", "x"), ("n7", "n3"), ("z", None), ("n5", "n5")], "src string, dst string"))
    rows = [r.node for r in graph.ordered_names(e).orderBy("place").collect()]
    users: dict[int, list[int]] = {}
    for k in range(1, n):
        users.setdefault(k // 2, []).append(k)
    free, want = ["n0"], []
    while free:
        want.append(heapq.heappop(free))
        for k in users.get(int(want[-1][1:]), ()):
            heapq.heappush(free, f"n{k}")
    assert rows == [*want, "x", "y"]
    assert graph.ordered_names(e.filter("src = dst")).collect() == []


def test_rewrites_compute_each_text_once_and_deal_rows_out(spark):
    df = spark.createDataFrame([("a",)], "zzz string")
    for suite in (rewrites.typography, rewrites.general_fixes, rewrites.repair):
        plan = df.select(suite(F.col("zzz")).alias("o"))._jdf.queryExecution().analyzed().toString()
        assert len(re.findall(r"zzz#", plan.split("\n")[0])) == 1, suite.__name__
    for name in ("typography_suite", "typography_whole", "general_fixes_whole", "syntax_repair"):
        assert "Exchange hashpartitioning" in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_strings_that_a_pattern_needs():
    known = {"\\bagar supaya\\b": "agar supaya", "(a|b)c": "c", "ab?c": "a", "a(bc)d": "abcd", "x+yz": "yz", "a{0,2}b": "b", "(?i)ab": "", "[ab]c\\.d": "c.d", "ab|c": "", "(?=ab)c": "c", "\\{\\{(?:x)\\}\\}": "{{x}}", "\\p{Lu}q\\s": "q", "(ab)*c": "c"}
    assert {p: rewrites.held(p) for p in known} == known


def test_large_dictionaries_join_only_phrases_that_can_be_keys(spark):
    keys = spark.range(2000).selectExpr("concat('kunci ', id) AS key", "'x' AS value")
    rows = spark.range(20_000).selectExpr("concat('kunci ', id) AS key")
    left = {r.key for r in rows.filter(dictionary._can_be(keys, 2000)(dictionary._place("key"))).collect()}
    assert {f"kunci {i}" for i in range(2000)} <= left and len(left) < 4000
    docs = spark.createDataFrame([("Kunci 7 dan kunci 2001",), (None,), ("",), ("Kunci 7 dan kunci 2001",)], "text string")
    found = [r.found for r in dictionary.apply_dictionary(docs, keys, sent_keys=0).collect()]
    assert sorted(str(f["text"]) for f in found) == ["", "None", "X dan kunci 2001", "X dan kunci 2001"]
