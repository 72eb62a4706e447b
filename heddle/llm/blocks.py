"""All true links inside groups of any size, compared in blocks: no row stands for a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, materialize
from heddle.llm.components import components

BLOCK = 400_000  # shingles in a block of a family


class Forest:
    """Union-find over positions, for a spanning forest inside one unit of work."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(ids: list[bytes], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the pairs (one of `left`, one of `right`) with 100 |a & b| >= percent |a | b|."""
    n = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.concatenate([start, [len(every)]]))
    keep = np.repeat(count > 1, count)
    col = np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    row = owner[keep]
    width = int(col[-1]) + 1 if len(col) else 0
    here, there = np.flatnonzero(left), np.flatnonzero(right)
    same = np.array_equal(here, there)
    both = np.zeros((len(here), len(there)), np.float32)
    step = max(64, min(4096, 4_000_000 // max(1, len(sets))))
    for c in range(0, width, step):
        a, z = np.searchsorted(col, [c, c + step])
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:z], col[a:z] - c] = 1
        mine = x[here]
        both += mine @ (mine if same else x[there]).T
    forest = Forest(len(sets))
    for k in range(0, len(here), 256):  # a few rows at a time, so that memory stays that of one matrix
        some = both[k : k + 256].astype(np.int32)
        near = (100 * some >= percent * (n[here[k : k + 256], None] + n[None, there] - some)) & (some > 0)
        for i, j in zip(*np.nonzero(near)):
            i, j = int(here[k + i]), int(there[j])
            if forest.join(i, j):
                yield min(ids[i], ids[j]), max(ids[i], ids[j])


def within(rest: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: links among the members of bands that stars left mixed (`rest`: key, id, comp), confirmed on full sets (`full`: id, shingles).

    Members that hang together by such bands are cut into blocks of bounded size; a pair of blocks
    is one unit of work, in which sets are intersected by a matrix product and a spanning forest of
    the true links is kept, so no row stands for a pair.
    """
    least = rest.groupBy("key").agg(F.min("id").alias("a"))
    found = components(rest.join(least, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "families")
    sizes = full.select("id", F.size("shingles").alias("n"))
    member = materialize(found.select(F.col("node").alias("id"), F.col("component").alias("family")).join(sizes, "id"), "members")
    sized = member.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    sized = sized.select("family", F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("m") / 1500)).cast("int").alias("blocks"))
    placed = member.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = []
            if len(rows) > 1:
                block = np.array([r[1] for r in rows])
                found = list(links([r[0] for r in rows], [r[2].view(np.uint64) for r in rows], block == now[1], block == now[2], percent))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])

        for b in batches:
            family, i, j, rep, block = (b.column(k).to_pylist() for k in range(5))
            for k in range(b.num_rows):
                if (key := (family[k], i[k], j[k])) != now:
                    if rows:
                        yield done()
                    now, rows = key, []
                rows.append((rep[k], block[k], b.column(5)[k].values.to_numpy()))
        if rows:
            yield done()

    work = units.join(full, "id")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    out = materialize(work.select("family", "i", "j", "id", "block", "shingles").mapInArrow(run, "a binary, b binary"), "within")
    discard(member, found)
    return out
