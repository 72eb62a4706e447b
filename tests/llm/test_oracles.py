"""Registered queries with SQL against DuckDB; the others give rows of a fixed schema."""

import duckdb
import pytest

from heddle.llm import queries as Q


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    rows = con.sql(Q.oracle_sql()[name])
    assert sorted(rows.columns) == cols
    assert got == sorted(tuple(map(norm, r)) for r in rows.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    n = df.count()
    assert n > 0
    if "doc_id" in df.columns:
        assert n == spark.read.parquet(f"{sf}/documents.parquet").count()
