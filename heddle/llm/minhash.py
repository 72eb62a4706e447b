"""Near-duplicate documents by MinHash (operator 9).

1. Each whole text becomes its set of word shingles (64-bit hashes); texts with equal sets
   form a class, named by 128 bits, so copies never meet pair by pair.
2. BANDS x ROWS universal hash minima give band keys; classes that share a key are suspects.
3. Within each band classes are compared by stars with changing centres (see `components`);
   what hangs together by bands that are still mixed is compared in blocks of bounded size.
4. Signature verification: a byte of each of the minima agrees in a share of them near the
   similarity; pairs whose agreement is over SIGMAS deviations below `percent` go. The others
   are confirmed on full sets.
5. Connected components of the links, by alternating large-star and small-star, are the
   near-duplicate components.

With 40 bands of 8 rows a pair at Jaccard 0.85 shares no band with probability 3e-6, and is
lost by its signature with 1e-8. Defined cases: a null, empty or blank text has an empty set,
n_shingles 0, and is its own component; fewer words than a shingle make one shingle; equal
rows count once, and an id with several texts has a row for each; a null id is no component's
name: rows without id have the least id of their component, are kept only where it has none,
and component_id is null there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.blocks import within
from heddle.llm.common import discard, materialize
from heddle.llm.components import classes

BANDS, ROWS = 40, 8
SIGMAS = 6
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20240229)
LETTER = _random.integers(0, 2**64, 256, np.uint64)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]  # A-Z as a-z
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
MUL = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
ADD = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and BACK to the powers 0 to n - 1, kept for the worker."""
    if len(_pow[0]) < n:
        for k, base in enumerate((BASE, BACK)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in text order."""
    b = np.frombuffer(raw, np.uint8)
    solid = np.concatenate([[False], ~SPACE[b], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    if not len(edge):
        return np.empty(0, np.uint64)
    start, stop = edge[::2], edge[1::2]
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up, dtype=np.uint64)])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of `size`-word shingles."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signed(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One 64-bit key for each band of the set's universal hash minima, and a byte of each minimum."""
    least = np.empty(BANDS * ROWS, np.uint64)
    for i in range(0, len(least), 16):
        m = np.full(16, np.uint64(2**64 - 1))
        for k in range(0, len(s), 8192):
            m = np.minimum(m, (MUL[i : i + 16, None] * s[None, k : k + 8192] + ADD[i : i + 16, None]).min(axis=1))
        least[i : i + 16] = m
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        h = mix(h + least.reshape(BANDS, ROWS)[:, i])
    return h, (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def named(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, version (hash of the text), n, name, bands and sketch for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, bands, sketches = [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                names.append(named(s) if len(s) else None)
                keys, sketch = signed(s) if len(s) else (None, None)
                bands.append(None if keys is None else keys.view(np.int64))
                sketches.append(sketch)
            cols = [pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "version", "n", "name", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, version bigint, n bigint, name binary, bands array<bigint>, sketch binary")


def candidates(sets: DataFrame) -> DataFrame:
    """key, id: the classes (by name) of each band that holds several."""
    keyed = sets.select(F.explode("bands").alias("key"), F.xxhash64("name").alias("code"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = materialize(keyed.join(shared, "key").select("key", "code"), "bands")
    held = materialize(members.join(sets.select(F.xxhash64("name").alias("code"), F.col("name").alias("id")), "code").select("key", "id"), "held")
    discard(members)
    return held


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose sizes and signatures allow `percent` similarity."""
    minima, share = BANDS * ROWS, percent / 100
    least = minima * share - SIGMAS * (minima * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, minima) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    side = lambda k, s, m: sets.select(F.col("name").alias(k), F.col("sketch").alias(s), F.col("n").alias(m))
    both = pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that their signatures allow and their full sets (id, shingles) confirm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                z = np.concatenate((x.values.to_numpy(), y.values.to_numpy()))
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                good.append(100 * both >= percent * (len(z) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda k, s: full.select(F.col("id").alias(k), F.col("shingles").alias(s))
    both = alike(pairs, sets, percent).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, text_col: str) -> DataFrame:
    """id (the name), shingles of the texts whose hash is in `wanted` (version)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s for t in b.column(0) if len(s := shingles(t.as_py(), size))]
            yield pa.RecordBatch.from_arrays([pa.array([named(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "shingles"])

    texts = docs.select(F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).join(wanted, "version", "left_semi")
    texts = texts.groupBy("version").agg(F.first("text").alias("text"))
    return texts.select("text").mapInArrow(run, "id binary, shingles array<bigint>").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept, version (xxhash64 of the text); kept is the least id of a component."""
    sig = materialize(signatures(docs, size, id_col, text_col), "signatures")
    sets = sig.where("n > 0").groupBy("name").agg(*(F.first(c).alias(c) for c in ("n", "version", "bands", "sketch")), F.min("id").alias("least"))
    sets = materialize(sets, "sets")
    held = candidates(sets)
    wanted = sets.join(held.select(F.col("id").alias("name")).distinct(), "name", "left_semi").select("version")
    full = materialize(full_sets(docs, wanted, size, text_col), "full")
    found = classes(held, lambda pairs: verified(pairs, sets, full, percent), lambda rest: within(rest, full, percent))
    discard(held, full)
    placed = sets.select("name", "least").join(found.select(F.col("node").alias("name"), "component"), "name", "left")
    placed = placed.withColumn("component", F.coalesce("component", "name"))
    top = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(top, "component").select("name", "component_id")
    rows = sig.select("id", "version", "n", "name").distinct().join(placed, "name", "left")
    # Without words a row is its own component, and so is the first of a component without ids.
    out = rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "version")
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
    out = materialize(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept", "version"), "marked")
    discard(sig, sets, found)
    return out
