"""Near-duplicate classes from LSH bands, and connected components, with DataFrame operations only.

Components come by alternating large-star and small-star.

Each round rewires every node's neighbours to the least neighbour: first the larger ones
(large-star), then the smaller ones and the node itself (small-star). Rounds repeat until
the edges no longer change; then every node hangs directly on its component's least node.
Each round is written to the shared folder, so a lost executor costs at most one round.

Classes: in each band every member is compared with one of them, its centre (a star), so that
a large group of variants becomes one component without its pairs. ROUNDS stars with other
centres follow in the bands that still hold several components, for members outside the
centre's. A centre then leaves its band, as all its links there are known; a band of up to
ROUNDS + 1 members is settled by stars alone. What is then still mixed is left to the operator's own way of comparing the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, materialize


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    far = both.where(F.col("b") > F.col("a"))
    return far.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """node, component (its least node) for every node of `edges(a, b)`; self loops are ignored.

    Without edges the result is empty. `most` only guards against a defect: the number of
    rounds is logarithmic in the component sizes.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    edges = materialize(edges, name)
    before = state(edges)
    for _ in range(most):
        if not before[0]:
            break
        last, edges = edges, materialize(small_star(large_star(edges)), name)
        after = state(edges)
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    hung = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = hung.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out.stored_at = edges.stored_at
    return out


ROUNDS = 3


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with comp: the component of id, else id itself."""
    named = found.select(F.col("node").alias("id"), "component")
    return rows.join(named, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def mixed(placed: DataFrame) -> DataFrame:
    """The rows of `placed` (key, id, comp) in bands of several components, with m, the members of the band."""
    code = F.xxhash64("comp")
    keys = placed.groupBy("key").agg(F.min(code).alias("x"), F.max(code).alias("y"), F.count("*").alias("m")).where("x < y").select("key", "m")
    return placed.join(keys, "key")


def around(rows: DataFrame, turn: int) -> DataFrame:
    """The members of each band but its centre of this turn, with the centre as c.

    The centre is one of those that meet most others over all bands (`met`, by powers of two),
    the least changed of a family of variants, which most of the others are near to.
    """
    order = F.struct(F.floor(F.log2("met")).alias("w"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp")
    centre = rows.groupBy("key").agg(F.max(order).alias("c"))
    return rows.join(centre, "key").where("id <> c.id")


def star(spread: DataFrame) -> DataFrame:
    """a, b: each band's centre with every member outside the centre's component."""
    pairs = spread.where("comp <> c.comp")
    return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def classes(held: DataFrame, verified: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component for the members of `held` (key, id) that are linked.

    `verified` keeps the true links of pairs (a, b); `rest` finds those among the members that
    stars leave in mixed bands (key, id, comp, m), and writes them.
    """
    sizes = held.groupBy("key").agg(F.count("*").alias("m"))
    met = held.join(sizes, "key").groupBy("id").agg(F.sum("m").alias("met"))
    now = materialize(held.join(met, "id").withColumn("comp", F.col("id")), "met")
    found, old = None, [now]

    def joined(links: DataFrame, name: str) -> DataFrame:
        """Components of all links so far: the last components stand for the links behind them."""
        links = materialize(links, "links")
        every = links if found is None else links.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b")))
        out = components(every, name)
        discard(links, *([] if found is None else [found]))
        return out

    for turn in range(ROUNDS):
        spread = around(now, turn)
        found = joined(verified(star(spread)), "stars")
        now = materialize(mixed(with_component(spread.select("key", "id", "met"), found)), "mixed")
        discard(*old)
        old = [now]
        if now.isEmpty():
            discard(now)
            return found
    last = rest(now)
    found = joined(last, "classes")
    discard(last, *old)
    return found
