"""An average that is exactly the limit is not below it, in whatever parts its rows are added."""

import os
import random

import duckdb

from heddle import registry
from heddle.sources.tables import TABLES

# 0.045 on average; some sums of two parts of them, as doubles, are just below 28 times that
TAXES = [x / 100 for x in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 5, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8)]


def test_exact_limit(spark, sf, tmp_path):
    con, draw = duckdb.connect(), random.Random(4)
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.mkdir(tmp_path / "lineitem.parquet")
    drawn = {key: draw.sample(TAXES, len(TAXES)) for key in range(1, 151)}
    for name, part in (("a", slice(0, 15)), ("b", slice(15, None))):
        rows = [(key, x) for key, taxes in drawn.items() for x in taxes[part]]
        values = ", ".join(f"({i}, {key}, {x}::DOUBLE)" for i, (key, x) in enumerate(rows))
        con.sql(f"COPY (SELECT l.* REPLACE (key AS l_partkey, 100000::DOUBLE AS l_extendedprice, 0.1::DOUBLE AS l_discount, tax AS l_tax) FROM (SELECT * FROM read_parquet('{sf}/lineitem.parquet') LIMIT 1) l, (VALUES {values}) v(i, key, tax) ORDER BY i) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    got = [tuple(r) for r in registry.load()["break_even"][0](spark, str(tmp_path)).collect()]
    assert len(got) == 150 and {uses for _, uses in got} == {None}
