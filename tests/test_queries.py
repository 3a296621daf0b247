"""Every core query against its SQL on the smallest dataset."""

import os

import duckdb
import pytest

from plumbline.plans import analysis_queries, hotkey_queries

DATA = "/root/testdata/sf0.001"
QUERIES = analysis_queries.QUERIES | hotkey_queries.QUERIES
SQL = analysis_queries.SQL | hotkey_queries.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, duck, run, sql):
    df = run(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_verdicts_of_every_file(spark):
    paths = {x.path for x in QUERIES["filter_supported"](spark, DATA).collect()}
    assert {x.path for x in QUERIES["verdicts"](spark, DATA).collect()} == paths
    assert QUERIES["project_summary"](spark, DATA).first().total == len(paths)


def test_no_plan_shuffles_contents(spark, capsys):
    for name in ("code_lines", "strip_aggressive", "normalize_ws", "file_metrics", "verdicts", "report_json", "cfg_verdicts", "issues_cross_file"):
        QUERIES[name](spark, DATA).explain("formatted")
        plan = capsys.readouterr().out
        for part in plan.split("\n\n"):
            if "Exchange" in part.split("\n")[0] and "Broadcast" not in part.split("\n")[0]:
                assert "content#" not in part and "text#" not in part, (name, part)
