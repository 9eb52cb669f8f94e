"""Every registered query with oracle SQL equals DuckDB on sf0.01 (rows, columns, values);
the others run and return their declared columns."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF01, SF001
from tools.compare import TABLES, rows_of

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_an_id():
    assert len(QUERIES) >= 80
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF01)
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF001)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # Every column holds a value somewhere, but for errors, which these inputs don't give, and
    # what is null by contract where nothing is found.
    empty = {c for c in df.columns if all(r[c] is None for r in rows)}
    assert empty <= {"error", "first_word", "last_word"}
    if "doc_id" in df.columns and name.startswith("op"):
        want = {r.doc_id for r in spark.read.parquet(f"{SF001}/documents.parquet")
                .select("doc_id").collect()}
        assert {r.doc_id for r in rows} == want


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["url", "title", "pos", "chunk"]
    assert df.count() > 0
