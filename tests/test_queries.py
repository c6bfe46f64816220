"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from quarrylens import detail_queries, plan_queries, queries, record_queries  # noqa: F401 - the others register with queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def normal(value):
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(queries.SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    assert found == sorted(tuple(normal(r[theirs.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_chunks_cover_all_lines(spark):
    rows = queries.chunk_overlap(spark, DATA).orderBy("doc_id", "chunk_no").collect()
    last = {}
    for r in rows:
        assert r.first_line <= last.get(r.doc_id, 0) + 1
        last[r.doc_id] = r.last_line
    lines = {r.doc_id: r.n_lines for r in queries.line_count(spark, DATA).collect()}
    assert last == lines
