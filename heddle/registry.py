"""Name -> (Spark query, oracle SQL or None) for the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
OPS: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its oracle SQL."""
    def add(f: Query) -> Query:
        if name in OPS:
            raise ValueError(f"query {name} is registered twice")
        OPS[name] = (f, sql)
        return f

    return add


def load() -> dict[str, tuple[Query, str | None]]:
    from heddle.queries import citations, contracts, dependencies, evaluation, governance, graph, heads, incremental, pages, retrieval, sources, versions, wiki  # noqa: F401

    return OPS


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load()["hybrid_search"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in load().items() if sql}
