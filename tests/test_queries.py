"""Every query with SQL against DuckDB on the same small tables."""

import math
import os

import duckdb
import pytest

from rasterspark.plans import layouts, payloads, queries

ORACLE_SQL, QUERIES = queries.ORACLE_SQL | layouts.ORACLE_SQL | payloads.ORACLE_SQL, queries.QUERIES | layouts.QUERIES | payloads.QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(ORACLE_SQL[name])
    want = _rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns) and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)
