"""Every query with SQL equals DuckDB's result; every other one runs.  On the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("CRATEWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, float) else str(v)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit()])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
