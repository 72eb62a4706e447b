"""Vectors of texts by feature hashing, and nearest vectors through an inverted file of k-means cells."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.fixpoint import written

# The dimension, the length that character features look at, and what a token is.
DIM, HEAD_CHARS = 384, 1800
TOKEN = re.compile(r"[a-z_][a-z0-9_]{1,}|[一-鿿]{1,4}")
SAMPLE, CELL_ROWS, MOST_CELLS, CHUNK = 8_192, 2_048, 1_024, 16_384
SLACK = 1e-6


def features(text: str | None) -> Iterator[str]:
    """Tokens of the whole text, and all 3- to 5-grams of its first characters with white space as one blank."""
    low = (text or "").lower()
    for token in TOKEN.findall(low):
        yield f"t:{token}"
    head = re.sub(r"\s+", " ", low[:HEAD_CHARS])
    for n in (3, 4, 5):
        for i in range(len(head) - n + 1):
            yield f"c:{head[i : i + n]}"


def blake(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")


def md5(feature: str) -> int:
    """The first 60 bits of the MD5, which SQL engines can compute too."""
    return int(hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def grams(heads: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Of all 3- to 5-grams of `heads`, length by length: the head of each, which of the distinct ones it is, and the distinct ones."""
    joined = "".join(heads)
    size = np.array([len(h) for h in heads], np.int64)
    point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds, letter = factorized(point)
    bits = max(1, (len(kinds) - 1).bit_length())
    if 5 * bits > 63:  # too many different characters for one number a gram; a single head never has them
        half = len(heads) // 2
        for part, first in ((heads[:half], 0), (heads[half:], half)):
            for own, which, names in grams(part):
                yield own + first, which, names
        return
    own, end = np.repeat(np.arange(len(heads)), size), np.repeat(np.cumsum(size), size)
    key = (letter[:-1] << bits) | letter[1:]
    for n in (3, 4, 5):
        key = (key[: len(joined) - n + 1] << bits) | letter[n - 1 :]
        at = np.flatnonzero(np.arange(len(key)) + n <= end[: len(key)])
        kinds, which = factorized(key[at])
        place = np.empty(len(kinds), np.int64)
        place[which] = at
        yield own[at], which, [joined[i : i + n] for i in place.tolist()]


def factorized(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and for each value which of them it is."""
    import pandas as pd

    which, kinds = pd.factorize(values)
    return kinds, which.astype(np.int64)


def signed_counts(texts: list[str | None], value=blake, dim: int = DIM, known: dict[str, int] | None = None) -> np.ndarray:
    """A row a text: each of its `features` adds 1 at its hash modulo `dim`, or -1 where the hash is odd; whole numbers, not yet normalised.

    Features of all texts are told apart first, so that each distinct one is hashed and looked up once.
    """
    known = {} if known is None else known

    def codes(names: Iterable[str], kind: str) -> np.ndarray:
        out = []
        for f in names:
            f = kind + f
            h = known.get(f)
            if h is None:
                h = value(f)
                h = known[f] = h % dim * 2 + (h & 1)
            out.append(h)
        return np.array(out, np.int64)

    if len(known) > 1_000_000:  # bounds the memo, not the features
        known.clear()
    lows = [(t or "").lower() for t in texts]
    found = [TOKEN.findall(low) for low in lows]
    place = {f: i for i, f in enumerate(dict.fromkeys(chain.from_iterable(found)))}
    which = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64)
    parts = [np.repeat(np.arange(len(texts)), [len(x) for x in found]) * (2 * dim) + codes(place, "t:")[which]]
    heads = [re.sub(r"\s+", " ", low[:HEAD_CHARS]) for low in lows]
    parts += [own * (2 * dim) + codes(names, "c:")[which] for own, which, names in grams(heads)]
    code = np.bincount(np.concatenate(parts), minlength=len(texts) * 2 * dim).reshape(len(texts), dim, 2)
    return code[:, :, 0] - code[:, :, 1]


def hashed(rows: DataFrame, id_col: str, text_col: str, value=blake, dim: int = DIM) -> DataFrame:
    """id_col, v (array<bigint>), norm (its squared length) of every text; a null text counts as empty, an empty one has norm 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for a in range(0, b.num_rows, 2_048):
                part = b.slice(a, 2_048)
                x = signed_counts(part.column(1).to_pylist(), value, dim, known)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, pa.array((x * x).sum(axis=1))], [id_col, "v", "norm"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, v array<bigint>, norm bigint")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centres of unit vectors; an empty cell keeps its centre."""
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        moved = unit(sums)
        centres = np.where((sums != 0).any(axis=1)[:, None], moved, centres)
    return centres


def stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


class InvertedFile:
    """Vectors (id, v, norm > 0) in cells, by cosine.

    Centres come from a bounded sample (SAMPLE rows by a hash of the id); every vector is indexed. A cell knows the
    greatest angle of its members, so a search can tell what a cell may hold at best. Cells over CHUNK rows are cut by a hash.
    """

    def __init__(self, vectors: DataFrame, cell_rows: int = CELL_ROWS):
        rows = vectors.where("norm > 0").select("id", "v", "norm")
        self.spark = vectors.sparkSession
        total = rows.count()
        self.cells = 0
        if not total:
            self.rows = rows.select(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("chunk"), "id", "v", "norm")
            return
        share = int(min(1.0, 0.9 * SAMPLE / total if total > SAMPLE else 1.0) * 1_000_000)
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < share).orderBy("id").limit(SAMPLE).collect()
        x = unit(np.array([r["v"] for r in drawn], np.float64))
        self.cells = min(MOST_CELLS, len(x), max(1, -(-total // cell_rows)))
        centres = self.centres = k_means(x, self.cells)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = unit(stacked(b.column(1))) @ centres.T
                    cell = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(near)), cell], -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *b.columns], ["cell", "angle", "id", "v", "norm"])

        kind = rows.schema["id"].dataType.simpleString()
        placed = written(rows.mapInArrow(assign, f"cell bigint, angle double, id {kind}, v array<bigint>, norm bigint"), "cells")
        stats = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()  # a row a cell
        self.angle, self.chunks = np.full(self.cells, -np.inf), np.zeros(self.cells, np.int64)
        for r in stats:
            self.angle[r["cell"]], self.chunks[r["cell"]] = r["angle"], -(-r["n"] // CHUNK)
        cut = self.spark.createDataFrame([(c, int(n)) for c, n in enumerate(self.chunks) if n], "cell bigint, chunks bigint")
        self.rows = placed.join(F.broadcast(cut), "cell").select("cell", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "v", "norm")

    def nearest(self, queries: DataFrame, keep: int = 30, probe: int | None = None) -> DataFrame:
        """qid, id, score, rank: the `keep` vectors of the greatest cosine (rounded to six places) for queries (qid, v, norm), ties to the smaller id.

        With `probe`, only so many nearest cells are searched. Without, the result is exact: a first round over the
        nearest cells gives a floor, a second opens every other cell whose angle allows a better vector.
        """
        asked = queries.where("norm > 0").select("qid", "v", "norm")
        if not self.cells:
            return asked.select("qid", F.lit(None).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).where("false")
        first = min(probe or 2, self.cells)
        found = self._round(asked.withColumn("floor", F.lit(-1.0)), keep, first, near=True)
        if probe is None:
            found = written(found, "near")
            kth = self._ranked(found, keep).where(F.col("rank") == keep).select("qid", F.col("score").alias("kth"))
            rest = asked.join(kth, "qid", "left").select("qid", "v", "norm", F.coalesce("kth", F.lit(-1.0)).alias("floor"))
            found = found.unionByName(self._round(rest, keep, first, near=False))
        return self._ranked(found, keep)

    def _ranked(self, found: DataFrame, keep: int) -> DataFrame:
        scored = found.select("qid", "id", F.round(F.col("dot") / F.sqrt(F.col("norms")), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("bigint")
        return scored.withColumn("rank", rank).where(F.col("rank") <= keep)

    def _round(self, asked: DataFrame, keep: int, first: int, near: bool) -> DataFrame:
        centres, angle, chunks = self.centres, self.angle, self.chunks
        names = ["cell", "chunk", "role", "id", "v", "norm", "floor"]

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = unit(stacked(b.column(1)))
                order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
                taken = np.zeros((len(q), len(centres)), bool)
                np.put_along_axis(taken, order[:, :first], True, axis=1)
                if not near:
                    to = np.arccos(np.clip(q @ centres.T, -1, 1))
                    best = np.cos(np.clip(to - angle, 0, np.pi))
                    taken = ~taken & (best >= b.column(3).to_numpy()[:, None] - SLACK)
                at, cell = np.nonzero(taken & (chunks > 0))
                often = chunks[cell]
                at, cell = np.repeat(at, often), np.repeat(cell, often)
                chunk = np.concatenate([np.arange(n) for n in often]) if len(often) else np.empty(0, np.int64)
                rows = pa.array(at)
                cols = [pa.array(cell), pa.array(chunk.astype(np.int32)), pa.array(np.ones(len(at), np.int32)), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), b.column(3).take(rows)]
                yield pa.RecordBatch.from_arrays(cols, names)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, block = None, [], None
            for b in batches:
                cell, chunk, role = (b.column(k).to_numpy() for k in range(3))
                cut = np.flatnonzero((cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])) + 1 if b.num_rows else []
                for i, j in zip([0, *cut], [*cut, b.num_rows]):
                    if i == j:
                        continue
                    part = b.slice(i, j - i)
                    if (key := (cell[i], chunk[i])) != now:
                        now, parts, block = key, [], None
                    ids, v, norm = part.column(3).to_numpy(zero_copy_only=False), stacked(part.column(4)), part.column(5).to_numpy()
                    if role[i] == 0:
                        parts.append((ids, v, norm))
                        continue
                    if not parts:
                        continue
                    block = block or tuple(np.concatenate(x) for x in zip(*parts))
                    floor = part.column(6).to_numpy()
                    for a in range(0, len(ids), 256):
                        z = slice(a, a + 256)
                        dot = v[z] @ block[1].T  # whole numbers: exact in doubles
                        norms = norm[z, None] * block[2]
                        near_ = np.round(dot / np.sqrt(norms), 6)
                        for r in range(len(dot)):
                            hit = np.flatnonzero(near_[r] >= floor[a + r] - SLACK)
                            hit = hit[np.lexsort((block[0][hit], -near_[r, hit]))[: keep + 4]]
                            if len(hit):
                                yield pa.RecordBatch.from_arrays([pa.array([ids[a + r]] * len(hit)), pa.array(block[0][hit]), pa.array(dot[r, hit].astype(np.int64)), pa.array(norms[r, hit])], ["qid", "id", "dot", "norms"])

        kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((asked, "qid"), (self.rows, "id"))}
        sent = asked.select("qid", "v", "norm", "floor").mapInArrow(probed, f"cell bigint, chunk int, role int, id {kinds['qid']}, v array<bigint>, norm bigint, floor double")
        data = self.rows.select("cell", "chunk", F.lit(0).alias("role"), F.col("id").cast(kinds["qid"]).alias("id"), "v", "norm", F.lit(0.0).alias("floor"))
        runs = data.unionByName(sent).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role", "id")
        return runs.mapInArrow(meet, f"qid {kinds['qid']}, id {kinds['qid']}, dot bigint, norms bigint")
