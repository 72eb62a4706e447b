"""Graph operators on edge relations. Traversals walk confirmed edges only and start from all seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_edges(observed: DataFrame) -> DataFrame:
    """src, dst, confidence, n_obs: logical edges with the number of places that observe them."""
    return observed.groupBy("src", "dst", "confidence").agg(F.countDistinct("tu").alias("n_obs"))


def merged(observed: DataFrame) -> DataFrame:
    """src, dst, kind, confidence, reason, n_obs: relations by kind and certainty, with the first reason given and the number of units that show them.

    `observed`: tu, seq, src, dst, kind, confidence, reason.
    """
    return observed.groupBy("src", "dst", "kind", "confidence").agg(F.min_by("reason", F.struct("tu", "seq")).alias("reason"), F.countDistinct("tu").alias("n_obs"))


def purge(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, the number of the others as n_orphans)."""
    ids = nodes.select("id").distinct()
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    gone = edges.agg(F.count("*").alias("n")).crossJoin(held.agg(F.count("*").alias("m")))
    return held, gone.select((F.col("n") - F.col("m")).alias("n_orphans"))


def definition_wins(nodes: DataFrame, key: str = "name") -> DataFrame:
    """One node a key: definitions before declarations, then the least id."""
    first = F.min_by(F.struct(*nodes.columns), F.struct((~F.col("is_definition")).cast("int"), "id"))
    return nodes.groupBy(key).agg(first.alias("n")).select("n.*")


def neighbors(edges: DataFrame, hops: int, seeds: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """seed, id, hop: nodes within `hops` of each seed, with the least hop. A seed on a cycle is found again.

    One join a level on the frontier of all seeds; each level is deduplicated before the next.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("id")).distinct()
    seeds = step.select(F.col("at").alias("seed")).distinct() if seeds is None else seeds.select("seed").distinct()
    level = seeds.join(step, seeds["seed"] == step["at"]).select("seed", "id").distinct()
    found = level.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        level = level.select("seed", F.col("id").alias("at")).join(step, "at").select("seed", "id").distinct()
        found = found.unionByName(level.withColumn("hop", F.lit(hop)))
    return found.groupBy("seed", "id").agg(F.min("hop").alias("hop"))


def fan_in_out(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out of every node on an edge; one shuffle for both counts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum(1 - F.col("e.i")).alias("fan_out"))


def expand_scores(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.75, keep: int = 24) -> DataFrame:
    """qid, id, score, rank: seed scores carried along edges, multiplied by `decay` a hop; the best `keep` a question."""
    from heddle.operators.ranking import top

    reached = neighbors(edges, hops, seeds.select(F.col("id").alias("seed")))
    carried = seeds.withColumnRenamed("id", "seed").join(reached, "seed").select("qid", "id", F.round(F.col("score") * F.pow(F.lit(decay), F.col("hop")), 6).alias("score"))
    best = carried.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top(best, "qid", [F.desc("score"), "id"], keep)


def subgraph(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, src, dst, confidence: edges with both ends among a seed's reached nodes or the seed itself."""
    members = reached.select("seed", "id").unionByName(reached.select("seed", F.col("seed").alias("id"))).distinct()
    out = members.withColumnRenamed("id", "src").join(edges.select("src", "dst", "confidence"), "src")
    return out.join(members.withColumnRenamed("id", "dst"), ["seed", "dst"]).select("seed", "src", "dst", "confidence")
