"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network (operator 13).

Tokens are runs of word bytes as written (letters, digits, all beyond ASCII) and runs of other
visible ASCII; a token is one of BUCKETS hash buckets, so the table of vectors has a size that
no corpus exceeds (BUCKETS x DIM numbers, 8 MB). Random indexing: every bucket owns a sparse index
vector of +1 and -1; a token's context vector is the sum of the index vectors of all tokens
within WINDOW places of it, over every document. Tasks add up whole numbers, blocks of
buckets are summed after one shuffle, and the centred, normalised rows are the word vectors.

A document is the mean and the root mean square of its tokens' vectors. A network of two layers
in NumPy learns from at most about `per_class` labelled rows of each class (a documented bound, by a
hash of the id), each class weighed as in all labels; every fifth of these rows is kept back to
fit the temperature that divides the network's output before it becomes a probability.

Texts are read as whole UTF-8 bytes in slices of SLICE bytes cut at blanks, so the memory of a task
does not depend on a text's length. Defined cases: a null, empty or blank text has no tokens
and zero features, and gets the network's score for them; ids that are null have no labels; an id
with several labels counts as good if one of them is; without rows of both classes every score is
(good + 1) / (labelled + 2); repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import sample_share

BUCKETS, DIM, NONZERO, WINDOW, BLOCK = 1 << 14, 64, 2, 2, 64
SLICE, TOKENS = 1 << 20, 1 << 15
PER_CLASS, HIDDEN, EPOCHS = 3_000, 32, 150
ODD = 0x9E3779B97F4A7C15  # any odd number serves: powers of it are invertible modulo 2^64


def classes() -> np.ndarray:
    """0 for blanks and controls, 1 for bytes of words, 2 for other visible ASCII."""
    kind = np.full(256, 2, np.uint8)
    kind[:33] = 0
    kind[127] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[a:b] = 1
    return kind


KIND = classes()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Tokens:
    """Buckets of all tokens of a batch of texts, and where each text's tokens begin."""

    def __init__(self) -> None:
        self.up, self.down = powers(SLICE + 1)

    def _slice(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and bucket of each token; `begins` holds the texts' first bytes."""
        if len(data) >= len(self.up):
            self.up, self.down = powers(len(data) + 1)
        kind = KIND[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[begins] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        seen = kind[start] > 0
        start, end = start[seen], end[seen]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(ODD)
        return start, (h >> np.uint64(64 - 14)).astype(np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each token, first token of each text and the number of all) of a binary column without nulls."""
        if not len(column):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        found, firsts, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            while end < len(data) and data[end] > 32 and not self._begins(offsets, end):  # never inside a token
                blank = np.flatnonzero(data[end : end + SLICE] <= 32)
                following = offsets[np.searchsorted(offsets, end)]
                end = min(end + int(blank[0]) if len(blank) else end + SLICE, int(following), len(data))
            inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
            start, bucket = self._slice(data[at:end], inside)
            firsts.append(start + at)
            found.append(bucket)
            at = end
        start = np.concatenate(firsts)
        return np.concatenate(found), np.searchsorted(start, offsets)

    @staticmethod
    def _begins(offsets: np.ndarray, at: int) -> bool:
        return bool(offsets[np.searchsorted(offsets, at)] == at)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the NONZERO entries of every bucket's index vector."""
    rng = np.random.default_rng(13)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def contexts(bucket: np.ndarray, first: np.ndarray, sums: np.ndarray) -> None:
    """Add the index vectors of all neighbours of the same text to the rows of `sums` (BUCKETS * DIM)."""
    place, sign = index_vectors()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(bucket), 4 * TOKENS):
        keys, signs = [], []
        for k in range(1, WINDOW + 1):
            left = np.arange(a, min(a + 4 * TOKENS, len(bucket) - k))
            left = left[text[left] == text[left + k]] if len(left) else left
            for x, y in ((bucket[left], bucket[left + k]), (bucket[left + k], bucket[left])):
                keys.append((x[:, None] * DIM + place[y]).ravel())
                signs.append(sign[y].ravel())
        sums += np.bincount(np.concatenate(keys), np.concatenate(signs), len(sums))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM vectors from the neighbours of every token of every document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(), np.zeros(BUCKETS * DIM)
        for b in batches:
            contexts(*tokens(b.column(0)), sums)
        blocks = sums.astype(np.int64).reshape(-1, BLOCK * DIM)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of[block] = of.get(block, 0) + np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int64()), pa.array([x.tobytes() for x in of.values()], pa.binary())], ["block", "sums"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("t"))
    parts = texts.mapInArrow(gather, "block bigint, sums binary").repartition("block").mapInArrow(add, "block bigint, sums binary")
    sums = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for r in parts.collect():  # BUCKETS / BLOCK rows, whatever the corpus
        sums[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return normalised(sums.reshape(BUCKETS, DIM))


def normalised(sums: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, less their mean, scaled again; rows of unseen buckets stay zero."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    seen = sums.any(axis=1)
    out = np.zeros_like(sums)
    if seen.any():
        rows = unit(sums[seen])
        out[seen] = unit(rows - rows.mean(axis=0))
    return out


def pooled(bucket: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and root mean square of the tokens' vectors of each text; zeros without tokens."""
    n, dim = np.diff(first), vectors.shape[1]
    sums = np.zeros((len(n), 2 * dim))
    for a in range(0, len(bucket), TOKENS):
        z = min(a + TOKENS, len(bucket))
        x = vectors[bucket[a:z]]
        texts = np.flatnonzero((first[:-1] < z) & (first[1:] > a) & (n > 0))
        starts = np.maximum(first[texts], a) - a
        sums[texts, :dim] += np.add.reduceat(x, starts)
        sums[texts, dim:] += np.add.reduceat(x * x, starts)
    sums /= np.maximum(n, 1)[:, None]
    sums[:, dim:] = np.sqrt(sums[:, dim:])
    return sums


def features(batch_column: pa.Array, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    return pooled(*tokens(batch_column), vectors)


@dataclass
class Network:
    """tanh layer and linear layer over standardised features; `temperature` divides the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted mean of the negative log-likelihood."""
    p = np.clip(sigmoid(z), 1e-12, 1 - 1e-12)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 13) -> Network:
    """Adam over mini-batches with weight decay; every fifth row fits the temperature and nothing else."""
    rng = np.random.default_rng(seed)
    kept_back = np.arange(len(y)) % 5 == 4
    if any(len(np.unique(y[part])) < 2 for part in (kept_back, ~kept_back)):
        kept_back[:] = False
    fit = np.flatnonzero(~kept_back)
    net = Network(x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    s = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            h = np.tanh(s[i] @ params[0] + params[1])
            g = (sigmoid(h @ params[2] + params[3][0]) - y[i]) * weight[i] / weight[i].sum()
            back = np.outer(g, params[2]) * (1 - h * h)
            slopes = [s[i].T @ back + 1e-3 * params[0], back.sum(axis=0), h.T @ g + 1e-3 * params[2], np.array([g.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                params[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if kept_back.any():
        z = net.logits(x[kept_back])
        grid = np.geomspace(0.25, 8, 61)
        net.temperature = float(min(grid, key=lambda t: loss(z / t, y[kept_back], weight[kept_back])))
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id",
        per_class: int = PER_CLASS) -> Callable[[np.ndarray], np.ndarray]:
    """A function from pooled features to probabilities, learned from `labels` (id_col, label_col).

    The sample is drawn from labels first; its ids, at most about `per_class` of each class, are broadcast.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in labels.groupBy("y").count().collect()}
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    constant = (good + 1) / (good + bad + 2)
    if not bad or not good:
        return lambda x: np.full(len(x), constant)
    share = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    drawn = labels.where(sample_share(F.col(id_col), share[0]) & (F.col("y") == 0) | sample_share(F.col(id_col), share[1]) & (F.col("y") == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2), tokens, vectors)), pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).cast("binary").alias("t")).join(F.broadcast(drawn), id_col)
    rows = texts.select(F.col(id_col).cast("string").alias("id"), "y", "t").mapInArrow(run, "id string, y int, x array<double>").collect()  # bounded by the sample
    rows.sort(key=lambda r: (hash_of(r["id"]), r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(np.unique(y)) < 2:
        return lambda x: np.full(len(x), constant)
    return train(np.array([r["x"] for r in rows]), y, np.where(y == 1, 1 / share[1], 1 / share[0]))


def hash_of(text: str) -> int:
    """An order of ids that has nothing to do with their size."""
    return zlib.crc32(text.encode())


def score(docs: DataFrame, vectors: np.ndarray, model: Callable[[np.ndarray], np.ndarray], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, score, n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            bucket, first = tokens(b.column(1))
            p = np.round(model(pooled(bucket, first, vectors)), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(np.diff(first))], [id_col, "score", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).cast("binary").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, score double, n_tokens bigint")
