"""Readers for the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark resolves the path, so any Hadoop file system works."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL text over the input tables."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
