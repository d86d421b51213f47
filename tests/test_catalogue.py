"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from corpusmill.plans import catalogue, lookups, markup, nesting  # noqa: F401  the others add their queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([rounded(r[c]) for c in cols]) for r in df.collect())
    if name not in catalogue.ORACLES:
        return
    rel = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted(repr([rounded(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert cols == sorted(names) and got == want


def test_flagship_needs_no_shuffle_and_reads_two_columns(spark):
    plan = catalogue.QUERIES["lint_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_typography_suite_runs_every_rule_pass():
    from corpusmill.operators import rewrites

    sql = catalogue.ORACLES["typography_suite"]
    for p in rewrites.TYPOGRAPHY:
        assert not markup.plain(p) or p in markup.PLAIN_TYPOGRAPHY and all(markup._quoted(a) in sql for a, _ in p.work), p.name
