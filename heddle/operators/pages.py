"""What pages of files and modules say: calls between files, flows, references, entries, and headers that a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.dependencies import REFERENCES
from heddle.operators.graph import neighbors
from heddle.operators.ranking import top


def placed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`edges` (src, dst and more) with src_path, src_name, dst_path and dst_name; edges of unknown nodes are left out."""
    a = nodes.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.col("name").alias("src_name"))
    b = nodes.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, "dst")


def neighbour_files(calls: DataFrame, reverse: bool = False, keep: int = 8) -> DataFrame:
    """path, other, n, rank: the files that a file calls most (with `reverse`: that call it), itself excepted, ties by path. `calls` as `placed`."""
    here, there = ("dst_path", "src_path") if reverse else ("src_path", "dst_path")
    n = calls.where(F.col(here) != F.col(there)).groupBy(F.col(here).alias("path"), F.col(there).alias("other")).agg(F.count("*").alias("n"))
    return top(n, "path", [F.desc("n"), "other"], keep)


def flows(calls: DataFrame, line: DataFrame, keep: int = 40) -> DataFrame:
    """path, caller, callee, rank: a file's first calls in the order of its lines. `line` (src, line_start)."""
    return top(calls.join(line, "src").select(F.col("src_path").alias("path"), F.col("src").alias("caller"), F.col("dst").alias("callee"), "line_start", "dst_name"), "path", ["line_start", "dst_name", "caller", "callee"], keep).select("path", "caller", "callee", "rank")


def file_facts(files: DataFrame, typed: DataFrame, candidates: DataFrame) -> DataFrame:
    """path, n_calls_out, n_calls_in, n_type_use, n_field_access, n_global_ref, n_candidates: a row for every path of `files`.

    `typed` (as `placed`, with kind) are confirmed relations, `candidates` (as `placed`) are not and are only counted.
    """
    crosses = (F.col("kind") == "calls") & (F.col("src_path") != F.col("dst_path"))
    count = lambda c: F.count(F.when(c, 1))
    out = typed.groupBy(F.col("src_path").alias("path")).agg(count(crosses).alias("n_calls_out"), *(count(F.col("kind") == k).alias(f"n_{k}") for k in REFERENCES))
    into = typed.where(crosses).groupBy(F.col("dst_path").alias("path")).agg(F.count("*").alias("n_calls_in"))
    open_ = candidates.groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("n_candidates"))
    rows = files.select("path").distinct().join(out, "path", "left").join(into, "path", "left").join(open_, "path", "left")
    return rows.fillna(0).select("path", "n_calls_out", "n_calls_in", *(f"n_{k}" for k in REFERENCES), "n_candidates")


def module_entries(nodes: DataFrame, fan_in: DataFrame, keep: int = 20) -> DataFrame:
    """module, id, fan_in, rank: a module's most called definitions. `nodes` (id, module, name), `fan_in` (id, fan_in)."""
    rows = nodes.join(fan_in, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return top(rows.select("module", "id", "name", "fan_in"), "module", [F.desc("fan_in"), "name", "id"], keep).drop("name")


def module_calls(calls: DataFrame, modules: DataFrame, keep: int = 20) -> DataFrame:
    """module, a, b, n, rank: the most frequent calls from a file of the module to another file. `modules` (path, module)."""
    n = calls.where("src_path <> dst_path").groupBy(F.col("src_path").alias("a"), F.col("dst_path").alias("b")).agg(F.count("*").alias("n"))
    return top(n.join(modules.withColumnRenamed("path", "a"), "a"), "module", [F.desc("n"), "a", "b"], keep).select("module", "a", "b", "n", "rank")


def including(includes: DataFrame, hops: int = 2) -> DataFrame:
    """path, other, hop: the files that include a file, directly or by way of another. `includes` (src_path, dst_path)."""
    edges = includes.where("src_path <> dst_path").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()
    return neighbors(edges, hops, reverse=True).select(F.col("seed").alias("path"), F.col("id").alias("other"), "hop")
