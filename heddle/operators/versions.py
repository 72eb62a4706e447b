"""Pages through versions: merge with counted versions, stale orphans, copy-on-write storage, invalidation events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators.dependencies import propagate
from heddle.operators.incremental import rollup  # noqa: F401

STATE = "id string, level string, input_hash string, status string, version bigint, revision string"


def merge(old: DataFrame, pages: DataFrame, revision: str) -> DataFrame:
    """The state after a generation, with `changed`: whether the row differs from the one before.

    `old` as STATE; `pages` (id, level, input_hash, valid) are all that the new revision has. An equal hash of a page that
    is ok is skipped: only its revision moves on. A new or changed one is written, `ok` or `failed`, with version + 1. A page that is gone becomes `stale`
    and keeps its version; if it comes back, its version goes on.
    """
    new = pages.select("id", F.col("level").alias("n_level"), F.col("input_hash").alias("n_hash"), F.col("valid").alias("n_valid"))
    both = old.join(new, "id", "full")
    gone = F.col("n_hash").isNull()
    skip = ~gone & (F.col("status") == "ok") & (F.col("input_hash") == F.col("n_hash"))
    skip = F.coalesce(skip, F.lit(False))
    status = F.when(gone, "stale").when(skip | F.col("n_valid"), "ok").otherwise("failed")
    version = F.when(gone | skip, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    changed = F.when(gone, F.col("status") != "stale").otherwise(~skip)
    return both.select("id", F.coalesce("n_level", "level").alias("level"), F.when(gone, F.col("input_hash")).otherwise(F.col("n_hash")).alias("input_hash"),
                       status.alias("status"), version.cast("bigint").alias("version"), F.when(gone, F.col("revision")).otherwise(F.lit(revision)).alias("revision"), changed.alias("changed"))


class PageStore:
    """State in buckets of files. A commit rewrites the buckets in which a page changed and names one folder a bucket in a numbered commit.

    Readers take the highest commit that is complete, so they see the state before or after, never between; a commit that
    died leaves folders that nothing names. Skipped pages keep their old revision here: moving it on would rewrite everything.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commits(self) -> list[int]:
        fs, at = self._hadoop(f"{self.root}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("n=") and fs.exists(self._hadoop(f"{self.root}/commits/{n}/_SUCCESS")[1])]
        return sorted(int(n[2:]) for n in done)

    def folders(self, commit: int | None = None) -> dict[int, str]:
        """Bucket -> folder, as a commit names them (the last by default); at most one a bucket."""
        done = self.commits()
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.root}/commits/n={done[-1] if commit is None else commit}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, commit: int | None = None) -> DataFrame:
        found = sorted(set(self.folders(commit).values()))
        if not found:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*found)

    def commit(self, pages: DataFrame, revision: str) -> list[int]:
        """Merge `pages` into the state; the buckets that were rewritten."""
        done = self.commits()
        number = (done[-1] + 1) if done else 0
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        state = merge(self.read(), pages, revision).withColumn("bucket", bucket)
        touched = state.where("changed").select("bucket").distinct()  # a row a bucket
        base = f"{self.root}/data/{number:08d}"
        state.join(F.broadcast(touched), "bucket", "left_semi").drop("changed").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(base)
        fs, at = self._hadoop(base)
        fresh = {int(f.getPath().getName()[7:]): f"{base}/{f.getPath().getName()}" for f in fs.listStatus(at) if f.getPath().getName().startswith("bucket=")}
        named = {**self.folders(), **fresh}
        self.spark.createDataFrame(sorted(named.items()), "bucket int, folder string").coalesce(1).write.json(f"{self.root}/commits/n={number}")
        return sorted(fresh)


def invalidations(before: DataFrame, after: DataFrame, consumers: DataFrame) -> DataFrame:
    """target, trigger, rule, path, before_hash, after_hash: an event for everything that a change of state reaches, with the path that led there.

    `before`, `after` (id, hash); `consumers` (child, parent) as recorded before. What appears or goes is a change too.
    """
    both = before.select("id", F.col("hash").alias("b"), F.lit(True).alias("was")).join(after.select("id", F.col("hash").alias("a"), F.lit(True).alias("is")), "id", "full")
    changed = both.where(F.col("was").isNull() | F.col("is").isNull() | ~F.col("a").eqNullSafe(F.col("b")))
    reached = propagate(changed.select("id"), consumers, both.count())
    trigger = F.element_at(F.split("path", ">"), 1)
    events = reached.select(F.col("id").alias("target"), trigger.alias("trigger"), F.col("mode").alias("rule"), "path")
    state = changed.select(F.col("id").cast("string").alias("trigger"), F.col("b").alias("before_hash"), F.col("a").alias("after_hash"))
    return events.join(state, "trigger", "left").select("target", "trigger", "rule", "path", "before_hash", "after_hash")


def islands(ranges: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """key, first, last: closed ranges of whole numbers united where they overlap or touch; empty ones are ignored. No number is exploded."""
    order = Window.partitionBy(key).orderBy(first, last)
    ahead = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens: Column = F.when(ahead.isNull() | (F.col(first) > ahead + 1), 1).otherwise(0)
    rows = ranges.where(F.col(first) <= F.col(last)).select(key, first, last).distinct().withColumn("_opens", opens)
    numbered = rows.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_island")


def gaps(required: DataFrame, covered: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """key, first, last: the parts of the required ranges that no covered range holds.

    Both sides are united first; their ends, put in order, tell where a required stretch is open and a covered one isn't.
    """
    def ends(rows: DataFrame, side: str, other: str) -> DataFrame:
        each = F.array(F.struct(F.col(first).alias("at"), F.lit(1).alias(side), F.lit(0).alias(other)), F.struct((F.col(last) + 1).alias("at"), F.lit(-1).alias(side), F.lit(0).alias(other)))
        return islands(rows, key, first, last).select(key, F.inline(each))

    marks = ends(required, "r", "c").unionByName(ends(covered, "c", "r")).groupBy(key, "at").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    order = Window.partitionBy(key).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    open_ = marks.select(key, F.col("at").alias(first), (F.lead("at").over(order) - 1).alias(last), F.sum("r").over(so_far).alias("r"), F.sum("c").over(so_far).alias("c"))
    return islands(open_.where("r > 0 and c = 0").select(key, first, last), key, first, last)
