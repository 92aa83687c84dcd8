"""The problem queries: SQL where it exists, columns as stated."""

import os

import pytest

from cratewright.llm import queries

FOLDER = os.environ.get("CRATEWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": "group_id bigint, field_name string, entry_id bigint",
    "p2_found": "lyrics_id bigint, stanza_no int, lang string",
    "p3_found": "entry_id bigint, field_name string",
    "p4_found": "credit_a bigint, credit_b bigint",
    "p5_found": "group_id bigint, entry_id bigint",
    "p6_found": "entry_id bigint, group_id bigint",
    "p7_found": "entry_id bigint, genre_id bigint",
    "p8_ids": "doc_id bigint, ids array<int>",
    "p10_found": "doc_id bigint, reading_level int",
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    import duckdb

    df = queries.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(tuple(r) for r in res.fetchall())
