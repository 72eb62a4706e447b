"""Structured Streaming twins of batch aggregates (an extension: the surveyed system has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.graph import dedup_edges


def tumbling(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """start, event_type, n, total for windows of `size`; the same on a batch and on a stream."""
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream_tumbling(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The same with a watermark: windows close `late` after their end and later rows are dropped."""
    return tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), size)


def store_batch(edges_path: str, batch: DataFrame, number: int) -> None:
    """Observations of one batch in a folder of their own: the same batch again replaces itself."""
    batch.select("tu", "src", "dst", "confidence").write.mode("overwrite").parquet(f"{edges_path}/batch={number}")


def observations_to(edges_path: str, observed: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keeps batches of observations (tu, src, dst, confidence) in `edges_path`; a unit that was read without any edge sends one row without src."""
    return observed.writeStream.foreachBatch(lambda batch, number: store_batch(edges_path, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_observations(spark: SparkSession, edges_path: str) -> DataFrame:
    """tu, src, dst, confidence as of now: a unit's last batch counts, what earlier ones saw of it is withdrawn."""
    schema = "tu bigint, src bigint, dst bigint, confidence string, batch bigint"
    rows = spark.read.schema(schema).option("basePath", edges_path).parquet(edges_path)
    last = rows.groupBy("tu").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["tu", "batch"], "left_semi").where("src is not null").select("tu", "src", "dst", "confidence")


def current_edges(spark: SparkSession, edges_path: str) -> DataFrame:
    """Logical edges of the current observations; an edge goes with its last one."""
    return dedup_edges(current_observations(spark, edges_path))
