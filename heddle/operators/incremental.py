"""Incremental refresh: plans, exact retraction, hash roll-ups, diffs, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import dedup_edges


def fingerprints(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key, fingerprint: order-free hash of a key's rows; partial sums, so no row list is gathered."""
    h = F.xxhash64(*content)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 40)).cast("decimal(20,0)")).alias("a"), F.bit_xor(h).alias("b")).select(key, F.sha1(F.concat_ws("|", "n", F.col("a").cast("string"), "b").cast("binary")).alias("fingerprint"))


def plan(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, action of two fingerprint tables: new, changed, reuse or removed."""
    both = old.withColumnRenamed("fingerprint", "o").join(new.withColumnRenamed("fingerprint", "n"), key, "full")
    action = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "reuse").otherwise("changed")
    return both.select(key, action.alias("action"))


def retract(observed: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after the observations of `gone` units are withdrawn; an edge goes with its last observation."""
    return dedup_edges(observed.join(gone.select("tu").distinct(), "tu", "left_anti"))


def refresh(observed: DataFrame, again: DataFrame) -> DataFrame:
    """Observations after the units in `again` (tu, src, dst, confidence) were read anew."""
    return observed.join(again.select("tu").distinct(), "tu", "left_anti").unionByName(again)


def rollup(children: DataFrame, parent: str, content: str = "hash") -> DataFrame:
    """parent, n_children, hash: a hash of the children's hashes that no order changes; sums only, so no list of a parent's children is built."""
    mark = F.conv(F.substring(content, 1, 12), 16, 10).cast("decimal(20,0)")
    other = F.conv(F.substring(content, 13, 12), 16, 10).cast("decimal(20,0)")
    sums = children.groupBy(parent).agg(F.count("*").alias("n_children"), F.sum(mark).alias("a"), F.sum(other).alias("b"))
    return sums.select(parent, "n_children", F.sha1(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n_children", "a", "b"))).cast("binary")).alias("hash"))


def merkle(children: DataFrame, parent: str, child: str, content: str = "hash") -> DataFrame:
    """parent, n_children, hash: a roll-up of what each child is called and holds; it changes with any of them, and no parent's children meet in one row."""
    named = F.sha1(F.concat_ws(":", F.col(child).cast("string"), F.col(content)).cast("binary"))
    return rollup(children.select(parent, named.alias("hash")), parent)


def orphans(rows: DataFrame, key: str, used: DataFrame, used_key: str) -> DataFrame:
    """Rows whose key nothing uses."""
    return rows.join(used.select(F.col(used_key).alias(key)).distinct(), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after of rows that differ, nulls being values."""
    both = old.select(key, F.col(value).alias("before"), F.lit(1).alias("o")).join(new.select(key, F.col(value).alias("after"), F.lit(1).alias("n")), key, "full")
    return both.where(F.col("o").isNull() | F.col("n").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after")
