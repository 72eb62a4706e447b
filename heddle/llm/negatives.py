"""Hard negatives by a vantage-point tree over norm-augmented vectors (operator 12).

Components become whole numbers floor(scale * x). Appending sqrt(M - |x|^2) to every vector and 0 to
an anchor, M being the greatest squared norm, turns inner products into distances:
d^2 = |anchor|^2 + M - 2 * score. A window of scores is then an annulus round the anchor, and
the highest scores in it are its nearest vectors.

* A vantage-point tree over a bounded sample (SAMPLE rows) deals all rows to leaves; leaves are
  cut by a hash into blocks, so a vector with many copies fills several blocks, not one.
* Each block grows its own tree. Anchors come in packs of PACK; the triangle inequality gives
  every (anchor, leaf) the least and greatest distance, leaves are opened nearest first, leaves
  outside the annulus are skipped, and an anchor stops when k rows are nearer than the next leaf.
* Every search has two rounds: an anchor's own block, whose k-th score narrows the window, then
  all other blocks that the narrowed annulus still meets. Results are exact at any size; an
  anchor's rows are joined by a window over its few candidates.

Searches: an anchor's `positives` best rows of its label, then for each of them the `k` best rows
of other labels with percent * positive <= 100 * score <= 100 * positive. Vectors without
structure meet all blocks, so work is then anchors times rows; the structure of the data decides.

Defined cases: rows take no part if id, label or vector are null, or a component is null or not
finite; shorter vectors count as padded with zeros; rows equal in id, label and vector count once,
other rows of one id each count but never meet their own id; ties go to the smaller id;
components and scores beyond 64 bits stop at the ends of that range; without anchors or positives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialize, sample_share

SAMPLE, PACK, LEAF = 8_192, 256, 512
BLOCK_ROWS, MOST_ROWS, MOST_LEAVES = 4_096, 131_072, 1_024
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Space:
    """Scores and distances for squared norms up to `m`; whole numbers in doubles where these are exact."""

    def __init__(self, m: float, dim: int):
        self.m, self.dim, self.slack = m, dim, 1e-6 * np.sqrt(max(m, 1.0))

    def rows(self, packed: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(packed), np.int64).reshape(-1, self.dim)
        return x.astype(np.float64) if self.m <= EXACT else x.astype(object)

    def score(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products of rows with rows, one column a row of `q`."""
        s = x @ q.T
        return s if s.dtype != object else np.minimum(np.maximum(s, LEAST), MOST)

    def lift(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in floats and their appended components."""
        x = x.astype(np.float64)
        return x, np.sqrt(np.maximum(self.m - (x * x).sum(axis=1), 0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of augmented rows."""
        (a, u), (b, w) = self.lift(x), self.lift(y)
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T) + (u[:, None] - w) ** 2
        return np.sqrt(np.maximum(square, 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of anchors `q` (rows) at which a row has `score` (anchors x any); inf at LEAST, which is no bound."""
        q, score = q.astype(np.float64), np.asarray(score, np.float64)
        d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.m - 2 * score, 0))
        return np.where(score <= LEAST, np.inf, d)


class Tree:
    """Vantage points split their rows at the median distance; `paths` bound each leaf's distances to them."""

    def __init__(self, space: Space, x: np.ndarray, leaf: int, seed: int = 12):
        self.space, self.rng, self.leaf = space, np.random.default_rng(seed), leaf
        self.points, self.radii, self.children, self.members = [], [], [], []
        self.paths: list[list[tuple[int, float, float]]] = []
        self.root = self._grow(x, np.arange(len(x)), [])
        self.points = np.stack(self.points) if self.points else x[:0]
        deep = max(map(len, self.paths), default=0)
        full = [p + [(-1, 0.0, np.inf)] * (deep - len(p)) for p in self.paths]
        self.at = np.array([[v for v, _, _ in p] for p in full], np.int64).reshape(len(full), deep)
        self.low = np.array([[a for _, a, _ in p] for p in full]).reshape(len(full), deep)
        self.high = np.array([[b for _, _, b in p] for p in full]).reshape(len(full), deep)

    def _grow(self, x: np.ndarray, own: np.ndarray, path: list[tuple[int, np.ndarray]]) -> int:
        if len(own) > self.leaf:
            point = x[own[self.rng.integers(len(own))]]
            d = self.space.between(x[own], point[None])[:, 0]
            cut = float(np.median(d))
            inner = d <= cut
            if inner.all():
                inner = d < cut
            if inner.any():
                node = len(self.points)
                self.points.append(point)
                self.radii.append(cut if (d[inner] == cut).any() else float(d[inner].max()))
                self.children.append([0, 0])
                for side, chosen in enumerate((inner, ~inner)):
                    below = [(v, e[chosen]) for v, e in path] + [(node, d[chosen])]
                    self.children[node][side] = self._grow(x, own[chosen], below)
                return node
        self.members.append(own)
        self.paths.append([(v, float(e.min()), float(e.max())) for v, e in path])
        return -len(self.members)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root, np.int64)
        if len(self.points):
            d = self.space.between(x, self.points)
            radii, children = np.array(self.radii), np.array(self.children)
            while (inner := np.flatnonzero(at >= 0)).size:
                n = at[inner]
                at[inner] = children[n, (d[inner, n] > radii[n]).astype(np.int64)]
        return -1 - at

    def loosen(self) -> None:
        """Bounds that hold for all rows that the splits send to a leaf, not only for those it grew from."""
        def walk(node: int, path: list[tuple[int, float, float]]) -> None:
            if node < 0:
                for k, (_, a, b) in enumerate(path):
                    self.low[-1 - node, k], self.high[-1 - node, k] = a, b
                return
            walk(self.children[node][0], [*path, (node, 0.0, self.radii[node])])
            walk(self.children[node][1], [*path, (node, self.radii[node], np.inf)])

        walk(self.root, [])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each anchor (rows) to each leaf (columns)."""
        if not len(self.points) or self.space.m > MOST / 4:  # scores that may stop at 64 bits tell no distance
            return np.zeros((len(q), len(self.members))), np.full((len(q), len(self.members)), np.inf)
        d = self.space.reach(q, self.space.score(self.points, q).T)[:, self.at]
        near = np.where(self.at >= 0, np.maximum(d - self.high, self.low - d), 0).max(axis=2)
        far = np.where(self.at >= 0, d + self.high, np.inf).min(axis=2)
        return np.maximum(near, 0) - self.space.slack, far + self.space.slack


def first_in_windows(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, label: np.ndarray,
                     low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, ids, scores): each window's k best rows, by a traversal from the nearest leaf on.

    `low` and `high` (anchors x windows) bound the scores; a window's bound rises to its k-th score as rows are found.
    """
    near, far = tree.bounds(q)
    inner = tree.space.reach(q, high) - tree.space.slack
    for a in range(len(q)):
        bound = [int(v) for v in low[a]]
        outer = tree.space.reach(q[a : a + 1], np.array([bound], float))[0] + tree.space.slack
        found: list[list[tuple[int, int]]] = [[] for _ in bound]
        for leaf in np.argsort(near[a], kind="stable"):
            open_ = (near[a, leaf] <= outer) & (far[a, leaf] >= inner[a])
            if not open_.any():
                if near[a, leaf] > outer.max():
                    break
                continue
            members = tree.members[leaf]
            s = tree.space.score(x[members], q[a : a + 1])[:, 0]
            fits = ((labels[members] == label[a]) == same) & (ids[members] != own[a])
            for w in np.flatnonzero(open_):
                hit = np.flatnonzero(fits & (s >= bound[w]) & (s <= int(high[a, w])))
                if not len(hit):
                    continue
                if len(hit) > 4 * k and s.dtype != object:
                    hit = hit[np.lexsort((ids[members[hit]], -s[hit]))[:k]]
                found[w] = sorted([*found[w], *((-int(s[i]), int(ids[members[i]])) for i in hit)])[:k]
                if len(found[w]) == k:
                    bound[w] = max(bound[w], -found[w][-1][0])
                    outer[w] = tree.space.reach(q[a : a + 1], np.array([[float(bound[w])]]))[0, 0] + tree.space.slack
        for w, rows in enumerate(found):
            if rows:
                yield a, w, np.array([i for _, i in rows], np.int64), np.array([-v for v, _ in rows], np.int64)


ROWS = "block bigint, id bigint, label bigint, v binary, key bigint"


def whole(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v (array<bigint>, floor(scale * x)) of the rows that take part, equal ones once."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = x.where("id is not null and label is not null and x is not null").where(fine)
    return x.select("id", "label", F.transform("x", lambda c: F.floor(scale * c)).alias("v")).distinct()


class Blocks:
    """All rows dealt to blocks of a tree's leaves, and what a search needs to know of them."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE):
        stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("m")).first()
        self.total, self.dim = stats["n"], max(stats["dim"] or 0, 1)
        self.space = space = Space(float(stats["m"] or 0), self.dim)
        dim, total = self.dim, self.total
        drawn = rows.where(sample_share(F.col("id"), min(1.0, 0.9 * sample / total) if total > sample else 1.0)).orderBy("id", "label", "v").limit(sample).collect()
        block_rows = min(max(block_rows, total // 512), MOST_ROWS)
        wanted = min(MOST_LEAVES, max(1, -(-total // block_rows)))
        fit = space.rows([padded(r["v"], dim) for r in drawn])
        self.tree = tree = Tree(space, fit, max(1, -(-len(fit) // wanted)))
        tree.loosen()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = [padded(v, dim) for v in b.column(2).to_pylist()]
                leaf = np.concatenate([tree.leaves(space.rows(packed[a : a + 4096])) for a in range(0, len(packed), 4096)]) if packed else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(1), pa.array(packed, pa.binary())], ["leaf", "id", "label", "v"])

        dealt = materialize(rows.select("id", "label", "v").mapInArrow(deal, "leaf bigint, id bigint, label bigint, v binary").withColumn("key", F.xxhash64("id", "label", "v")), "leaves")
        chunks = {r["leaf"]: -(-r["n"] // (2 * block_rows)) for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
        self.leaves = sorted(chunks)
        self.first = dict(zip(self.leaves, np.cumsum([0, *(chunks[x] for x in self.leaves)]).tolist()))
        self.leaf_of = np.repeat(np.array(self.leaves, np.int64), [chunks[x] for x in self.leaves])
        deals = rows.sparkSession.createDataFrame([(x, self.first[x], chunks[x]) for x in self.leaves], "leaf bigint, first bigint, chunks bigint")
        placed = dealt.join(F.broadcast(deals), "leaf")
        self.rows = placed.select((F.col("first") + F.pmod("key", "chunks")).alias("block"), "id", "label", "v", "key")

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, key, window, id, score: the k best rows of each window of `asked` (block, id, label, v, key, low, high as arrays)."""
        best = materialize(self._round(asked, same, k, own=True), "near")
        last = best.groupBy("anchor", "key", "window").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
        raised = last.groupBy(F.col("anchor").alias("id"), "key").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # a few windows an anchor
        low = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.col("kth")[i.cast("int")], v)))
        rest = asked.join(raised, ["id", "key"], "left").withColumn("low", low).drop("kth")
        found = best.unionByName(self._round(rest, same, k, own=False))
        rank = F.row_number().over(Window.partitionBy("anchor", "key", "window").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _round(self, asked: DataFrame, same: bool, k: int, own: bool) -> DataFrame:
        """One round over anchors' own blocks, or over all others that their windows reach."""
        space, tree, leaf_of, n_blocks = self.space, self.tree, self.leaf_of, len(self.leaf_of)
        names = ["block", "role", "id", "label", "v", "low", "high", "home"]

        def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = b.column(0).to_numpy()
                v, ids, labels, keys = b.column(3).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(4).to_numpy()
                low, high = (np.array(b.column(c).to_pylist(), np.int64).reshape(b.num_rows, -1) for c in (5, 6))
                for a in range(0, b.num_rows, PACK):
                    z = slice(a, a + PACK)
                    if own:
                        reached = {int(h): np.flatnonzero(home[z] == h) for h in np.unique(home[z])}
                    else:
                        q = space.rows(v[z])
                        near, far = tree.bounds(q)
                        outer = (space.reach(q, low[z]) + space.slack)[:, None, :]
                        inner = (space.reach(q, high[z]) - space.slack)[:, None, :]
                        meets = ((near[:, :, None] <= outer) & (far[:, :, None] >= inner)).any(axis=2)[:, leaf_of]
                        meets[np.arange(len(q)), home[z]] = False
                        reached = {x: np.flatnonzero(meets[:, x]) for x in range(n_blocks)}
                    for block, who in reached.items():
                        if len(who):
                            who = who + a
                            pack = [np.stack([ids[who], keys[who]]).tobytes(), labels[who].tobytes(), b"".join(v[i] for i in who), low[who].tobytes(), high[who].tobytes()]
                            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), *(pa.array([x], pa.binary()) for x in pack), pa.array([len(who)], pa.int64())], names)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rows, built = None, [], None
            for b in batches:
                block, role = b.column(0).to_numpy(), b.column(1).to_numpy()
                cols = [b.column(c).to_pylist() for c in range(2, 8)]
                for i in range(b.num_rows):
                    if block[i] != now:
                        now, rows, built = block[i], [], None
                    if role[i] == 0:
                        rows.append((cols[0][i], cols[1][i], cols[2][i]))
                        continue
                    if not rows:
                        continue
                    if built is None:
                        x = space.rows([r[2] for r in rows])
                        built = Tree(space, x, LEAF), x, *(np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in (0, 1))
                    n = cols[5][i]
                    who = np.frombuffer(cols[0][i], np.int64).reshape(2, n)
                    low, high = (np.frombuffer(cols[c][i], np.int64).reshape(n, -1) for c in (3, 4))
                    got = list(first_in_windows(*built, space.rows([cols[2][i]]), who[0], np.frombuffer(cols[1][i], np.int64), low, high, same, k))
                    if got:
                        often = [len(r) for _, _, r, _ in got]
                        at = np.repeat([a for a, _, _, _ in got], often)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(who[0][at]), pa.array(who[1][at]), pa.array(np.repeat([w for _, w, _, _ in got], often).astype(np.int32)), pa.array(np.concatenate([r for _, _, r, _ in got])), pa.array(np.concatenate([s for _, _, _, s in got]))],
                            ["anchor", "key", "window", "id", "score"])

        eight = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.col(c)), 16, "0"), 15 - 2 * i, 2) for i in range(8))))  # noqa: E731  little-endian bytes
        none = F.lit(None).cast("binary")
        data = self.rows.select("block", F.lit(0).alias("role"), eight("id").alias("id"), eight("label").alias("label"), "v", none.alias("low"), none.alias("high"), F.lit(None).cast("bigint").alias("home"))
        schema = "block bigint, role int, id binary, label binary, v binary, low binary, high binary, home bigint"
        parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = asked.select("block", "id", "label", "v", "key", "low", "high").repartitionByRange(max(1, min(parts, n_blocks)), "block", "id").mapInArrow(packs, schema)
        runs = data.unionByName(sent).repartition(max(1, min(parts, n_blocks)), "block").sortWithinPartitions("block", "role")
        return runs.mapInArrow(meet, "anchor bigint, key bigint, window int, id bigint, score bigint")


def padded(v: list[int], dim: int) -> bytes:
    """A vector as `dim` 64-bit numbers."""
    return np.array([*v, *[0] * (dim - len(v))], np.int64).tobytes()


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k: int = 5, positives: int = 5, percent: int = 80, scale: int = 256,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every id in `anchors` (id_col)."""
    blocks = Blocks(materialize(whole(vectors, id_col, label_col, vector_col, scale), "whole"), block_rows)
    asked = materialize(blocks.rows.join(anchors.select(F.col(id_col).cast("bigint").alias("id")).distinct(), "id", "left_semi"), "anchors")
    every = lambda v: F.array(F.lit(v).cast("bigint"))  # noqa: E731  one window without bounds
    own = materialize(blocks.search(asked.withColumn("low", every(LEAST)).withColumn("high", every(MOST)), True, positives), "positives")
    chosen = own.where("score >= 0").select("anchor", "key", F.struct("rank", F.col("id").alias("positive"), "score").alias("p"))
    listed = chosen.groupBy(F.col("anchor").alias("id"), "key").agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most `positives` an anchor
    width = F.lit(positives)
    score = lambda i: F.get(F.col("p"), i)["score"]
    at = F.sequence(F.lit(0), width - 1)
    # Places without a positive get an empty window.
    low = F.transform(at, lambda i: F.coalesce(least(score(i), percent), F.lit(MOST)))
    high = F.transform(at, lambda i: F.coalesce(score(i), F.lit(LEAST)))
    windows = asked.join(listed, ["id", "key"]).withColumn("low", low).withColumn("high", high)
    found = blocks.search(windows.drop("p"), False, k)
    paired = found.join(listed.withColumnRenamed("id", "anchor"), ["anchor", "key"]).withColumn("q", F.get("p", F.col("window")))
    return paired.select(F.col("anchor").alias("anchor_id"), F.col("q.positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                         F.col("id").alias("negative_id"), F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score"))


def least(score: Column, percent: int) -> Column:
    """The least whole number n with 100 * n >= percent * score."""
    return F.ceil(score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("bigint")
