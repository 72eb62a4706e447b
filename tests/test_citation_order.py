"""Citations whose line and node tie: tags follow the order of the input, in whatever order its files are read."""

import os

import duckdb

from heddle import registry
from heddle.sources.tables import TABLES

# the order that the query's SQL leaves open is made total by the place in the input
OPEN, TOTAL = "ORDER BY line, node) AS tag", "ORDER BY line, node, filename, file_row_number) AS tag"


def test_ties_follow_the_input(spark, sf, tmp_path):
    con = duckdb.connect()
    os.mkdir(tmp_path / "lineitem.parquet")
    # the first file is the smaller one, which Spark reads last; its lines come again in the second, from this repository
    for name, tax, rows in (("a", 0.08, 300), ("b", 0.0, 6000)):
        con.sql(f"COPY (SELECT * REPLACE ({tax}::DOUBLE AS l_tax) FROM read_parquet('{sf}/lineitem.parquet') LIMIT {rows}) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet', filename = true, file_row_number = true)")
    query, sql = registry.load()["citation_validity"]
    assert sql.count(OPEN) == 1
    sql = sql.replace(OPEN, TOTAL).replace("l_quantity FROM lineitem", "l_quantity, filename, file_row_number FROM lineitem")
    columns = ("answer", "line", "node", "tag", "valid", "complete")
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).select(*columns).collect())
    want = sorted(con.sql(sql).select(*columns).fetchall())
    assert sum(a != b for a, b in zip(got, want)) == 0 and len(got) == len(want)
