"""Removal of byte strings that an earlier document holds, by prefix-free parsing (operator 1).

A string of LENGTH bytes is repeated in a document if it also starts in a document with a
smaller id; every byte under a repeated string goes. Strings are judged on the input.

1. Chunks. Whole documents are written, compressed, in chunks of about CHUNK bytes to the
   shared folder; a chunk is the unit of all later work.
2. Parse. A rolling hash of TRIGGER bytes cuts documents into phrases; a phrase also holds
   the LENGTH - 1 bytes behind it, so every string lies in exactly one phrase and equal
   phrases hold equal strings (the parse is prefix-free). The chunk's dictionary has each
   distinct phrase once, with the least id that holds it, in the order of a 96-bit hash.
   A phrase that an earlier document holds is repeated as a whole; what is left are first
   occurrences.
3. Suffixes. A suffix of the dictionary matters only by its first LENGTH bytes, and equal
   ones have the same minimizer (least hash of the KMER-byte strings inside). Minimizers of
   first occurrences are put into one corpus order; only suffixes whose minimizer several
   documents hold are ordered further, by a 96-bit tabulation hash of their bytes. As only
   equality at that depth counts, the order is that of the hashes, not of the bytes; equal
   strings are neighbours in it all the same, across phrases and chunks.
4. Every order is made of hash ranges (buckets). A chunk asks a bucket about each distinct
   key once; the bucket answers one bit: whether an earlier document (for minimizers:
   another chunk) has it. So a copy, line or passage that a third of all documents hold is
   one entry a chunk, and no task gathers its places.

Defined cases: null and empty texts have no bytes; documents shorter than LENGTH keep all;
a null id counts as larger than every id; rows of equal id do not remove from each other,
and each gets its own result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialize

LENGTH, TRIGGER, KMER, PHRASE = 50, 16, 32, 64
CHUNK, BUCKET = 2 << 20, 8 << 20  # bytes of text in a chunk, and for each bucket
BLOCK = 1 << 17
LAST = 2**63 - 1  # the place of a null id
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
ROW = "chunk bigint, role int, bucket int, ids binary, sizes binary, body binary"


# --- bytes of arrays -------------------------------------------------------------------


def dump(*arrays: np.ndarray) -> bytes:
    """64-bit arrays as compressed byte planes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    planes = (np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def load(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, -1).T).view(np.uint64).ravel())
        at += 8 * size
    return out


def stepped(x: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; np.cumsum undoes it."""
    return np.diff(x, prepend=np.uint64(0))


# --- the parse of a chunk --------------------------------------------------------------


def doubled(h: np.ndarray, k: int, level: int) -> np.ndarray:
    """Hashes of strings of twice k bytes from those of k."""
    return h[:-k] * ODD[level] + h[k:]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    return x ^ (x >> np.uint64(29))


def block_hashes(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the hash of its TRIGGER bytes, and the least hash of KMER bytes within its `length` bytes."""
    h = spread((b.astype(np.uint64) + np.uint64(1)) * ODD[0])
    for level, k in enumerate((1, 2, 4)):
        h = doubled(h, k, level)
    sixteen = doubled(h, 8, 3)
    least = spread(doubled(sixteen, 16, 4))
    width, k = length - KMER + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: -(width - k)], least[width - k :])
    return spread(sixteen * ODD[5]), least


class Chunk:
    """Documents of a chunk: their phrases, and their runs of places with one minimizer."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, body: bytes, length: int):
        self.ids, self.length = ids, length
        self.bytes = np.frombuffer(body, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        long = sizes >= length
        first, stop = self.starts[long], self.ends[long] - length + 1  # places where strings start
        n = len(self.bytes)
        padded = np.concatenate([self.bytes, np.zeros(length + 64, np.uint8)])
        marks, cuts, mins = [], [], []
        before = None
        for a in range(0, n, BLOCK):
            z = min(n, a + BLOCK)
            trigger, least = block_hashes(padded[a : z + length], length)
            new = np.empty(z - a, bool)
            new[1:] = least[1 : z - a] != least[: z - a - 1]
            new[0] = before is None or least[0] != before
            before = least[z - a - 1]
            hit = trigger[: z - a] & np.uint64(PHRASE - 1) == 0
            for edge in (first, stop):
                inside = edge[np.searchsorted(edge, a) : np.searchsorted(edge, z)] - a
                new[inside] = hit[inside] = True
            at = np.flatnonzero(new)
            cuts.append(at + a)
            mins.append(least[at])
            marks.append(np.flatnonzero(hit) + a)
        none = np.empty(0, np.int64)
        self.run_at, self.run_end, self.run_doc, keep = self._ranges(np.concatenate(cuts or [none]), first, stop, long)
        self.run_min = np.concatenate(mins or [np.empty(0, np.uint64)])[keep]
        self.phrase_at, self.phrase_end, self.phrase_doc, _ = self._ranges(np.concatenate(marks or [none]), first, stop, long)

    def _ranges(self, cuts, first, stop, long):
        """Start, end and document of the ranges of string starts between cuts."""
        if not len(first):
            none = np.empty(0, np.int64)
            return none, none, none, np.zeros(len(cuts), bool)
        doc = np.searchsorted(first, cuts, "right") - 1
        keep = (doc >= 0) & (cuts < stop[doc])
        end = np.append(cuts[1:], len(self.bytes))
        end = np.minimum(end, stop[doc])
        return cuts[keep], end[keep], np.flatnonzero(long)[doc[keep]], keep

    def dictionary(self) -> Keys:
        """The distinct phrases."""
        view, more = memoryview(self.bytes), self.length - 1
        names = b"".join([xxhash.xxh3_128_digest(view[a : z + more]) for a, z in zip(self.phrase_at.tolist(), self.phrase_end.tolist())])
        wide = np.frombuffer(names, ">u8").astype(np.uint64).reshape(-1, 2)
        return Keys(wide[:, 0], wide[:, 1] >> np.uint64(32), self.ids[self.phrase_doc])

    def first_seen(self, old_phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, Keys]:
        """Masks of string starts in repeated and in first phrases, and the distinct minimizers of the latter.

        Minimizers are cut to 48 bits: a chance agreement only has strings looked at in vain.
        """
        old = self.dictionary().older(old_phrase)
        known, fresh = (self.filled(self.phrase_at[x], self.phrase_end[x]) for x in (old, ~old))
        seen = np.concatenate([[0], np.cumsum(fresh)])
        some = seen[self.run_end] > seen[self.run_at]
        self.run_at, self.run_end, self.run_doc, self.run_min = (x[some] for x in (self.run_at, self.run_end, self.run_doc, self.run_min))
        return known, fresh, Keys(self.run_min & ~np.uint64(0xFFFF), None, self.run_doc)

    def filled(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A mask of places covered by disjoint ranges."""
        edge = np.zeros(len(self.bytes) + 1, np.int8)
        edge[at] += 1
        np.subtract.at(edge, end, 1)
        return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)

    def suspects(self, fresh: np.ndarray, mins: Keys, elsewhere: np.ndarray) -> np.ndarray:
        """String starts of first phrases whose minimizer another document's first phrases hold too."""
        shared = (elsewhere | mins.several)[mins.group] if len(mins.group) else np.zeros(0, bool)
        return np.flatnonzero(fresh & self.filled(self.run_at[shared], self.run_end[shared]))

    def suffixes(self, at: np.ndarray) -> Keys:
        """The distinct strings that start at `at`, by a 96-bit tabulation hash."""
        table = tables(self.length)
        hi, lo = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for a in range(0, len(at), 65_536):
            part = at[a : a + 65_536]
            for j in range(self.length):
                c = self.bytes[part + j]
                hi[a : a + 65_536] ^= table[0, j][c]
                lo[a : a + 65_536] ^= table[1, j][c]
        doc = np.searchsorted(self.ends, at, "right")
        return Keys(hi, lo >> np.uint64(32), self.ids[doc])


@lru_cache(maxsize=4)
def tables(length: int) -> np.ndarray:
    return np.random.default_rng(length).integers(0, 2**64, (2, length, 256), np.uint64)


class Keys:
    """Distinct keys of a chunk in the order of their hashes, each with the least id that has it."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray | None, ids: np.ndarray):
        order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
        s, t = hi[order], None if lo is None else lo[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1] if t is None else (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        first = np.flatnonzero(new)
        self.hi, self.lo = s[first], None if t is None else t[first]
        self.least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
        self.several = np.maximum.reduceat(ids[order], first) != self.least if len(first) else np.zeros(0, bool)
        self.group = np.empty(len(s), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.own = ids > self.least[self.group] if len(s) else np.zeros(0, bool)

    def older(self, old: np.ndarray) -> np.ndarray:
        """For each place: whether an earlier document has its key; `old` says so of the distinct keys' least ids."""
        return self.own | old[self.group] if len(self.group) else self.own

    def slices(self, bits: int) -> np.ndarray:
        """Where each bucket of the keys begins, and the end."""
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.append(np.searchsorted(self.hi, edges), len(self.hi))


def asked(chunk: int, bits: int, keys: Keys) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, chunk, request) for each bucket that has keys of the chunk."""
    at = keys.slices(bits)
    for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
        a, z = at[k], at[k + 1]
        if keys.lo is None:
            yield k, chunk, dump(stepped(keys.hi[a:z] >> np.uint64(16)))
        else:
            yield k, chunk, dump(stepped(keys.hi[a:z]), keys.lo[a:z], keys.least[a:z].view(np.uint64))


def answer(requests: list[list[np.ndarray]]) -> np.ndarray:
    """For each key of a bucket's requests: with ids, whether the same key came with a smaller one; without, whether it came again."""
    hi = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in requests])
    if len(requests[0]) > 1:
        return Keys(hi, np.concatenate([x[1] for x in requests]), np.concatenate([x[2] for x in requests]).view(np.int64)).own
    keys = Keys(hi, None, np.repeat(np.arange(len(requests)), [len(x[0]) for x in requests]))
    return keys.several[keys.group]


# --- Spark jobs ------------------------------------------------------------------------


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ROW: role 0, ids, sizes and compressed bytes of each chunk; bucket holds nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, body, held = [], [], [], 0
        first, k = TaskContext.get().partitionId() << 32, 0
        press = zstandard.ZstdCompressor(level=3)

        def done() -> pa.RecordBatch:
            return rows_of([(first + k, 0, 0, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), press.compress(b"".join(body)))])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py() or b""
                ids.append(LAST if doc is None else doc)
                sizes.append(len(raw))
                body.append(raw)
                held += len(raw)
                if held >= CHUNK or len(ids) >= 50_000:
                    yield done()
                    ids, sizes, body, held, k = [], [], [], 0, k + 1
        if ids:
            yield done()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, ROW)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in ROW.split(", ")])


def opened(batch: pa.RecordBatch, k: int, length: int) -> Chunk:
    ids, sizes, body = (batch.column(c)[k].as_py() for c in (3, 4, 5))
    return Chunk(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), zstandard.ZstdDecompressor().decompress(body), length)


def grouped(batches: Iterator[pa.RecordBatch], length: int, rounds: int) -> Iterator[tuple[int, Chunk, list[np.ndarray]]]:
    """Each chunk with its answers: for each round, a bit for each distinct key in order."""
    now, chunk, bits = None, None, {}
    joined = lambda: [np.concatenate([*bits.get(k, []), np.zeros(0, bool)]) for k in range(1, rounds + 1)]
    for b in batches:
        keys, roles = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k in range(b.num_rows):
            if keys[k] != now:
                if chunk is not None:
                    yield now, chunk, joined()
                now, chunk, bits = keys[k], None, {}
            if roles[k] == 0:
                chunk = opened(b, k, length)
            else:
                raw = b.column(5)[k].as_py()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                bits.setdefault(roles[k], []).append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))[:n].astype(bool))
    if chunk is not None:
        yield now, chunk, joined()


def answered(requests: DataFrame, role: int, parts: int, name: str) -> DataFrame:
    """ROW: the answer to each request, found in its bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            bits, out, a = answer([x for _, x in held]), [], 0
            for chunk, (keys, *_) in held:
                z = a + len(keys)
                out.append((chunk, role, now, None, None, np.array([z - a], np.int64).tobytes() + np.packbits(bits[a:z]).tobytes()))
                a = z
            return rows_of(out)

        for b in batches:
            for k, (bucket, chunk) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if bucket != now:
                    if held:
                        yield done()
                    now, held = bucket, []
                held.append((chunk, load(b.column(2)[k].as_py())))
        if held:
            yield done()

    sorted_ = requests.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    return materialize(sorted_.mapInArrow(run, ROW), name)


ASK = "bucket int, chunk bigint, body binary"


def requests_of(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "body"])


def repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed runs; with `texts` also kept (binary)."""
    if length <= KMER:
        raise ValueError(f"length must be over {KMER}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialize(chunked(docs, id_col, text_col), "chunks")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(4, (total // BUCKET).bit_length())

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield requests_of(list(asked(b.column(0)[k].as_py(), bits, opened(b, k, length).dictionary())))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, (one,) in grouped(batches, length, 1):
            yield requests_of(list(asked(name, bits, chunk.first_seen(one)[2])))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, (one, two) in grouped(batches, length, 2):
            _, fresh, mins = chunk.first_seen(one)
            yield requests_of(list(asked(name, bits, chunk.suffixes(chunk.suspects(fresh, mins, two)))))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, (one, two, three) in grouped(batches, length, 3):
            known, fresh, mins = chunk.first_seen(one)
            at = chunk.suspects(fresh, mins, two)
            known[at[chunk.suffixes(at).older(three)]] = True
            yield results(chunk, known, texts)

    met = lambda *tables: reduce(DataFrame.unionByName, tables).repartition(parts, "chunk").sortWithinPartitions("chunk", "role", "bucket")
    one = answered(chunks.mapInArrow(phrases, ASK), 1, parts, "phrases")
    two = answered(met(chunks, one).mapInArrow(minimizers, ASK), 2, parts, "minimizers")
    three = answered(met(chunks, one, two).mapInArrow(suffixes, ASK), 3, parts, "suffixes")
    kind = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"
    out = met(chunks, one, two, three).mapInArrow(last, kind + ", kept binary" * texts)
    return out.withColumn("id", F.when(F.col("id") != LAST, F.col("id"))).withColumnRenamed("id", id_col)


def results(chunk: Chunk, repeated: np.ndarray, texts: bool) -> pa.RecordBatch:
    """The results of a chunk's documents from the mask of repeated string starts."""
    n, seen = len(chunk.bytes), np.concatenate([[0], np.cumsum(repeated)])
    here = np.arange(n)
    covered = seen[here + 1] > seen[np.maximum(here + 1 - chunk.length, 0)]
    edge = np.zeros(n + 1, bool)
    edge[chunk.starts] = True
    edge = edge[:n]
    rise = covered & (edge | ~np.concatenate([[False], covered[:-1]]))
    fall = covered & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([covered[1:], [False]])) if n else covered
    up, down = np.flatnonzero(rise), np.flatnonzero(fall) + 1
    a, z = np.searchsorted(up, chunk.starts), np.searchsorted(up, chunk.ends)
    left = np.concatenate([[0], np.cumsum(~covered)])[np.append(chunk.starts, n)] if len(chunk.starts) else np.zeros(1, np.int64)
    kept = memoryview(chunk.bytes[~covered].tobytes())
    pieces = [kept[i:j] for i, j in zip(left[:-1].tolist(), left[1:].tolist())]
    sizes = chunk.ends - chunk.starts
    lists = [[x[i:j] - s for i, j, s in zip(a, z, chunk.starts)] for x in (up, down)]
    cols = [
        pa.array(chunk.ids), pa.array(sizes), pa.array(sizes - np.diff(left)), pa.array(z - a),
        pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()),
        *(pa.array(x, pa.list_(pa.int64())) for x in lists),
    ]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    if texts:
        cols.append(pa.array([bytes(x) for x in pieces], pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(cols, names)
