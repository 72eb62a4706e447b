"""Benchmark decontamination by edit distance (operator 3).

A document is contaminated by an item when a window of its normalised text (lower case,
white space runs as one space) is within MAX_EDITS of the item's length in edit distance.

1. Where item-sized windows begin: a window within MAX_EDITS of an item of n characters
   shares at least n - Q + 1 - Q * MAX_EDITS * n of its Q-grams (the q-gram lemma), on
   diagonals at most MAX_EDITS * n from its start. Only places with so many are looked at,
   which loses no window within MAX_EDITS; the grams say where the window may begin.
2. CGK: each such window, and each item, walks randomly through itself; the walk maps edit
   distance to Hamming distance. At MAX_EDITS edits two walks agree on 24 to 40 % of
   coordinates (insertions only, replacements only), unrelated ones on 11 % (measured).
3. Bit sampling: REPEATS times, SAMPLED coordinates of a walk make a key; a window is a
   candidate of the item if one key agrees. Recall is 1 - (1 - p^SAMPLED)^REPEATS: 0.96 at
   p = 0.24, 0.99 at p = 0.28, for each of up to three places where the window may begin.
4. Each candidate is verified by exact edit distance against the text there.

Items so short that the lemma says nothing about them (fewer than 20 characters) are compared
everywhere, those under SHORT by containment. Items go to the tasks in blocks of at most
ITEM_CHARS characters, one after the other, each block's result written before the next, so
nothing broadcast or held by the driver grows with the benchmark. Defined cases: null, empty
and blank texts match nothing; items without text or id are left out; of equal matches the
first place counts; repeated rows are checked each; null document ids are kept as null; an
empty table of documents or items gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialize

Q, SHORT = 5, 8
MAX_EDITS = 0.15
WALKS, SAMPLED, REPEATS = 8, 3, 240
ITEM_CHARS, BUCKETS, BATCH = 4_000_000, 20, 256
TOGETHER = 1 << 21
CHUNK = 1 << 15  # characters of a batch that are looked at together
STEP = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buckets(c: np.ndarray) -> np.ndarray:
    """A bucket for every Q-gram; two grams in one bucket make more places to look at, but lose none."""
    h = c.astype(np.uint64)
    g = h[: len(h) - Q + 1]
    for k in range(1, Q):
        g = g * STEP + h[k : len(h) - Q + 1 + k]
    return ((g ^ (g >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def cgk(texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """2 * longest x texts x WALKS: each walk writes the current character, then stays or moves by a random bit."""
    longest = int(sizes.max())
    block = np.zeros((len(texts), longest + 1), np.uint32)  # 0 pads past the end
    for k, (t, n) in enumerate(zip(texts, sizes)):
        block[k, : min(n, len(t))] = t[:n]
    at = np.zeros((len(texts), WALKS), np.int64)
    row = np.arange(len(texts))[:, None]
    seed = mix(np.arange(1, WALKS + 1, dtype=np.uint64) * STEP)
    out = np.empty((2 * longest, len(texts), WALKS), np.uint32)
    for j in range(2 * longest):
        out[j] = block[row, np.minimum(at, longest)]
        at += (mix(out[j] * STEP + seed + np.uint64(j * 0x632BE5AB)) & np.uint64(1)).astype(np.int64)
    return out


@lru_cache(maxsize=4096)
def picked(size: int) -> np.ndarray:
    """REPEATS x SAMPLED coordinates of the walks of a text of this size."""
    return np.random.default_rng(size * 7 + 1).integers(0, 2 * size, (REPEATS, SAMPLED))


def keys_of(texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """texts x REPEATS keys, each of SAMPLED coordinates of one walk of the text's first `size` characters."""
    walked = cgk(texts, sizes)
    picks = np.stack([picked(int(n)) for n in sizes])
    which = np.arange(len(texts))[:, None]
    h = np.broadcast_to(np.arange(1, REPEATS + 1, dtype=np.uint64), (len(texts), REPEATS))
    for s in range(SAMPLED):
        h = mix(h * STEP + walked[picks[:, :, s], which, np.arange(REPEATS) % WALKS])
    return h


def edit_search(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of `text` nearest to `item`, the first of equals; None beyond `most`.

    Bit-parallel dynamic programming: one step per character of `text`, bits along `item`.
    """
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    of: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        of[c] |= 1 << i
    pv, mv, now, best = mask, 0, m, (m, 0)
    for k, c in enumerate(text, 1):
        eq = of.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        now += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if now < best[0]:
            best = (now, k)
    return best if best[0] <= most else None


class Items:
    """A block of benchmark items: their grams by bucket, and the keys of their walks."""

    def __init__(self, items):
        made = sorted((i, normal(t)) for i, t in items)
        self.short = [(i, t) for i, t in made if 0 < len(t) < SHORT]
        self.items = [(i, t) for i, t in made if len(t) >= SHORT]
        n = np.array([len(t) for _, t in self.items], np.int64)
        self.size, self.slack = n, np.floor(MAX_EDITS * n + 1e-9).astype(np.int64)
        self.least = n - Q + 1 - Q * self.slack
        self.anywhere = np.flatnonzero(self.least < 1).tolist()
        wide = np.flatnonzero(self.least >= 1)
        self.wide = len(wide)
        if not self.wide:
            return
        grams = [buckets(codes(self.items[k][1])) for k in wide]
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(wide, [len(g) for g in grams])[order]
        place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=1 << BUCKETS))]).astype(np.int32)
        self.span = int(n.max() + self.slack.max()) + 1
        self.width = int(2 * self.slack.max() + 1).bit_length()  # bits of a diagonal in one cell
        self.cols = ((CHUNK + 3 * self.span) >> self.width) + 3
        # A gram at `at` of the text adds to its item's diagonal at + offset, all diagonals of all items on one line.
        self.offset = owner.astype(np.int64) * (self.cols << self.width) - place + self.span
        self.place = place.astype(np.int32)
        self.keys: dict[int, np.ndarray] = {}
        for b in range(0, self.wide, BATCH):
            part = wide[b : b + BATCH]
            for k, row in zip(part.tolist(), keys_of([codes(self.items[k][1]) for k in part], n[part])):
                self.keys[k] = row

    def windows(self, c: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
        """(item, least, greatest start, likely starts) of the windows with enough grams of an item on near diagonals."""
        found = []
        for base in range(0, len(c) - Q + 1, CHUNK):
            g = buckets(c[base : base + CHUNK + 2 * self.span + Q - 1])
            found += [(k, base + lo, base + hi, [base + s for s in starts]) for k, lo, hi, starts in self._windows(g)]
        return found

    def _windows(self, g: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
        lo = self.first[g]
        times = self.first[g + 1] - lo
        where = np.flatnonzero(times)
        if not len(where):
            return []
        lo, times = lo[where], times[where]
        ends = np.cumsum(times)
        at = np.repeat(lo - ends + times, times) + np.arange(ends[-1], dtype=np.int32)
        line = self.offset[at] + np.repeat(where, times)
        cell = line >> self.width
        # Two neighbouring cells cover the diagonals of any window; only full ones are counted exactly.
        seen = np.bincount(cell, minlength=len(self.items) * self.cols).reshape(-1, self.cols)
        full = seen[:, :-1] + seen[:, 1:] >= np.maximum(1, self.least)[:, None]
        if not full.any():
            return []
        near = np.zeros(seen.shape, bool)
        near[:, :-1] = full
        near[:, 1:] |= full
        held = np.flatnonzero(near.ravel()[cell])
        # An item's gram counts once, however often the text repeats it.
        once = np.unique(cell[held] * self.span + self.place[at[held]]) // self.span
        seen = np.bincount(once, minlength=seen.size).reshape(seen.shape)
        full = seen[:, :-1] + seen[:, 1:] >= np.maximum(1, self.least)[:, None]
        near[:] = False
        near[:, :-1] = full
        near[:, 1:] |= full
        held = held[near.ravel()[cell[held]]]
        order = np.argsort(line[held], kind="stable")
        key, place = line[held][order], self.place[at[held]][order]
        room = self.cols << self.width
        item = key // room
        count = np.searchsorted(key, key + 2 * self.slack[item] + 1) - np.arange(len(key))
        found, last = [], -1
        for x in np.flatnonzero(count >= self.least[item]).tolist():
            if key[x] <= last:
                continue
            z = x + int(count[x])
            if len(np.unique(place[x:z])) < self.least[item[x]]:
                continue
            starts = key[x:z] - int(item[x]) * room - self.span
            values, times = np.unique(starts, return_counts=True)
            likely = {int(values[times.argmax()]), int(starts[place[x:z].argmin()]), int(np.median(starts))}
            found.append((int(item[x]), int(starts[0]), int(starts[-1]), sorted(likely)))
            last = int(key[z - 1])
        return found

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, distance) for the normalised texts of a batch."""
        out = [(r, i, t.find(x), t.find(x) + len(x), 0) for r, t in enumerate(texts) for i, x in self.short if x in t]
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for r, t in enumerate(texts):
            for k in self.anywhere:
                spans[r, k].append((0, len(t)))
        if self.wide:
            for (r, k), span in self.candidates([codes(t) for t in texts]):
                spans[r, k].append(span)
        for (r, k), near in spans.items():
            i, item = self.items[k]
            for low, high in sorted(near):
                if hit := edit_search(item, texts[r][low:high], int(self.slack[k])):
                    end = low + hit[1]
                    out.append((r, i, max(0, end - len(item)), end, hit[0]))
                    break
        return out

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """((row, item), (from, to)) of the windows with a key of the item. All texts of the batch are looked at as one."""
        begin = np.cumsum([0, *(len(c) + 1 for c in texts)])
        one = np.concatenate([x for c in texts for x in (c, np.zeros(1, np.uint32))]) if texts else np.zeros(0, np.uint32)
        asked = []
        for w in self.windows(one):
            r = int(np.searchsorted(begin, (w[1] + w[2] + self.size[w[0]]) // 2, "right")) - 1
            if 0 <= r < len(texts):
                asked += [(r, max(0, s - int(begin[r])), w) for s in w[3]]
        asked.sort(key=lambda x: self.size[x[2][0]])
        done = set()
        for b in range(0, len(asked), BATCH):
            part = asked[b : b + BATCH]
            keys = keys_of([texts[r][s:] for r, s, _ in part], self.size[[w[0] for *_, w in part]])
            for (r, _, (k, lo, hi, _)), row in zip(part, keys):
                if (row == self.keys[k]).any() and (r, k, lo) not in done:
                    done.add((r, k, lo))
                    at = int(begin[r])
                    yield (r, k), (max(0, lo - at - int(self.slack[k])), max(0, hi - at + int(self.size[k] + self.slack[k])))


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) cut to about TOGETHER bytes of text; a longer text is a batch of its own."""
    for b in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(b.column(1)), 0))
        part = np.cumsum(sizes) // TOGETHER
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


@lru_cache(maxsize=2)
def indexed(items: tuple[tuple[int, str], ...]) -> Items:
    """The block's index, built once in each Python worker."""
    return Items(items)


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, item_id, start, end, distance: one row per document and item found in it (places in normalised text)."""
    bench = bench.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // ITEM_CHARS) or 1
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for block in range(blocks):
        items = [(r[0], r[1]) for r in bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch], items=tuple(items)) -> Iterator[pa.RecordBatch]:
            index = indexed(items)
            for b in parted(batches):
                got = index.matches([normal(t) for t in b.column(1).to_pylist()])
                rows = pa.array([r for r, *_ in got], pa.int64())
                cols = [pa.array([x[k] for x in got], pa.int64()) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *cols], ["id", "item_id", "start", "end", "distance"])

        part = source.mapInArrow(run, f"id {kind}, item_id bigint, start bigint, end bigint, distance bigint")
        parts.append(part if blocks == 1 else materialize(part, "contaminated"))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, version (xxhash64 of the text), items: the distinct item ids found in each contaminated text of an id, null ids too."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version")).alias("row")
    found = matches(docs.select(row, F.col(text_col).alias("text")), bench, "row", "text")
    return found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.col("row.id").alias(id_col), F.col("row.version").alias("version"), "items")
