"""Every registered query against DuckDB on the same tables."""

import duckdb
import pytest

from heddle import registry
from heddle.sources.tables import TABLES

OPS = registry.load()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(OPS))
def test_against_oracle(spark, sf, con, name):
    f, sql = OPS[name]
    df = f(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if sql is None:
        assert got
        return
    rows = con.sql(sql)
    assert sorted(rows.columns) == cols
    assert got == sorted(tuple(map(norm, r)) for r in rows.select(*cols).fetchall())
