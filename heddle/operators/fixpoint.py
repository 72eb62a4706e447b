"""Fixpoints on Spark: rounds over the rows that the last round added, each written to the shared folder.

A round's plan reads the delta and the folder of all rounds, so plans stay as small in the
fiftieth round as in the first, and a lost executor costs a part of one round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of this machine, and only if Spark is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="heddle-")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: later jobs start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], name: str = "grow") -> DataFrame:
    """All rows that `start` leads to, with the number of the `round` that added them.

    `step` maps a round's new rows to candidates of the same columns, one a key; those whose key is
    known are dropped. It ends with the first round that adds nothing, whatever their number.
    """
    spark, columns = start.sparkSession, start.columns
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = start.withColumn("round", F.lit(0)).schema

    def add(rows: DataFrame, k: int) -> DataFrame:
        rows.select(*columns).write.parquet(f"{base}/round={k}")
        return spark.read.schema(start.schema).parquet(f"{base}/round={k}")

    delta, k = add(start.dropDuplicates(key), 0), 0
    while not delta.isEmpty():
        seen = spark.read.schema(schema).option("basePath", base).parquet(base)
        k += 1
        delta = add(step(delta).join(seen.select(*key), key, "left_anti"), k)
    return spark.read.schema(schema).option("basePath", base).parquet(base)


def on_cycles(pointers: DataFrame) -> DataFrame:
    """id, length: the nodes that come back to themselves along `pointers` (src, dst; one dst a src), and in how many steps.

    Pointer doubling: jumps of 1, 2, 4, ... steps shrink the set of nodes that are still met until jumps
    map it one to one onto itself, that is the cycles; then the least id within 1, 2, 4, ... steps
    spreads until nothing changes. Rounds grow with the logarithm of the longest chain.
    """
    step = written(pointers.select(F.col("src").alias("id"), F.col("dst").alias("to")).where("id is not null and to is not null"), "pointers")
    jump, alive = step, step.count()
    while alive:
        met = jump.select(F.col("to").alias("id")).distinct()
        left = written(step.join(met, "id", "left_semi"), "met")  # pointers of nodes that some node of the last round reaches
        onto = left.select("to").distinct().join(left.select(F.col("id").alias("to")), "to", "left_semi").count()
        still = left.count()
        if onto == still and still == met.count():
            step = left
            break
        jump = written(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "jumps")
        alive = jump.limit(1).count()
    if not alive:
        return pointers.sparkSession.createDataFrame([], f"id {pointers.schema['src'].dataType.simpleString()}, length bigint")
    least = step.select("id", "to", F.least("id", "to").alias("least"))
    changed = True
    while changed:
        ahead = least.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("other"))
        both = written(least.join(ahead, "to").select("id", F.col("next").alias("to"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed")), "least")
        changed = both.where("changed").limit(1).count() > 0
        least = both.drop("changed")
    size = least.groupBy("least").agg(F.count("*").alias("length"))
    return least.select("id", "least").join(size, "least").select("id", "length")
