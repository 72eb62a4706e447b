"""Ranks, budgets, sampling and windows over total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, key: str | list[str], order: list, keep: int | None = None, name: str = "rank") -> DataFrame:
    """Rank within a key; Spark keeps only `keep` rows of a key before the shuffle (WindowGroupLimit)."""
    key = [key] if isinstance(key, str) else key
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint"))
    return ranked if keep is None else ranked.where(F.col(name) <= keep)


def numbered(rows: DataFrame, order: list, key: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The rank that `top` gives, but no task holds all rows of a key: a sort by ranges, and the sizes of a key's earlier ranges.

    The sorted rows are written once, so that places and sizes come from the same partitions. Without `key` the rank is over all rows.
    """
    from heddle.operators.fixpoint import written

    key = list(key or [])
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place below
    ordered = written(rows.orderBy(*key, *order).withColumn("_at", at), "ordered").withColumn("_part", F.shiftright("_at", 33))
    runs = ordered.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a key and range
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    placed = ordered.join(runs.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_part").alias("_p"), "_first", "_before"), F.expr(" and ".join(["_part = _p", *(f"`{k}` <=> `_{k}`" for k in key)])))
    return placed.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*rows.columns, name)


def small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """`rows`, to be broadcast if a count shows that they are few; otherwise joined like any table."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """`rows`, dealt by `key` if the table `read` that they come from is read by fewer tasks than there are cores."""
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows if tasks >= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(key)


def prefix_within(rows: DataFrame, key: str, order: list, cost: str, budget: float) -> DataFrame:
    """The rows of a key up to the first that overflows the budget."""
    running = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def first_fit(rows: DataFrame, key: str, order: str, cost: str, item: str, budget: int) -> DataFrame:
    """key, item: rows taken in order while they fit; a row that doesn't fit is skipped, later ones may still fit.

    A fold over a question's candidates, of which a lane's top-k leaves a bounded number.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("bigint").alias("c"), F.col(item).alias("i"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def fold(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["c"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["kept"], x["i"])).otherwise(acc["kept"]).alias("kept"),
        )

    folded = rows.groupBy(key).agg(sorted_.alias("r")).select(key, F.aggregate("r", start, fold).alias("f"))
    return folded.select(key, F.explode("f.kept").alias(item))


def round_robin(rows: DataFrame, group: str, order: list) -> DataFrame:
    """`turn`: the row's number within its group, which may hold any share of all rows; sorting by (turn, group) interleaves the groups."""
    return numbered(rows, order, [group], "turn")


def text_windows(rows: DataFrame, id_col: str, text_col: str, size: int = 90, stride: int = 60) -> DataFrame:
    """id_col, start, n_words: overlapping windows of words, the last one shorter."""
    words = rows.select(id_col, F.size(F.filter(F.split(text_col, r"\s+"), lambda x: x != "")).alias("n"))
    at = words.where("n > 0").select(id_col, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride))).alias("start"))
    return at.select(id_col, F.col("start").cast("bigint").alias("start"), F.least(F.lit(size), F.col("n") - F.col("start")).cast("bigint").alias("n_words"))
