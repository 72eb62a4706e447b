"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; an error where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files go as soon as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the files of materialized steps that nothing reads any more."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.stored_at)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo `folds`: the split into training and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample_share(column, share: float):
    """A fixed share of rows by a hash of `column`; the same rows on every run."""
    return F.pmod(F.xxhash64(column, F.lit(7919)), F.lit(1_000_000)) < F.lit(int(round(share * 1_000_000)))
