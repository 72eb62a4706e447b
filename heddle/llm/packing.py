"""Token ids packed into fixed-length rows, written as binary columns (operator 8).

Every task encodes its documents and packs windows of at most WINDOW tokens (bounded memory,
no shuffle). Texts with more than `length` tokens are cut into consecutive pieces, losslessly;
`starts` holds each segment's offset in its document. Pieces are placed by best-fit
decreasing: a segment tree over remaining capacities 0..length finds the fullest row that
still takes a piece in O(log length). A row holds its ids as little-endian unsigned 16-bit
(32-bit for larger vocabularies) padded to `length`, cumulative segment lengths, and
positions that restart at 0 with every segment.

Defined cases: null and empty texts have no tokens and so no segment; repeated rows are
packed each; an empty table gives no rows. The same input split gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.bpe import RANKS, encode_text, encoding

LENGTH, WINDOW = 2048, 2_000_000
SCHEMA = (
    "shard bigint, row bigint, n_tokens int, n_segments int, doc_ids array<bigint>, starts array<bigint>, "
    "cu_seqlens array<int>, ids binary, positions binary"
)


class Capacities:
    """A segment tree over capacities: open rows by what they still take, least sufficient first."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        i = left + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the least capacity >= need."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        left = i - self.size
        row = self.rows[left].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return left, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the pieces in each row, by best-fit decreasing; ties by index."""
    open_rows, out = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = open_rows.take(sizes[k])
        if found is None:
            found = (length, len(out))
            out.append([])
        left, row = found
        out[row].append(k)
        if left > sizes[k]:
            open_rows.put(left - sizes[k], row)
    return out


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows with SCHEMA; `pad` fills the rest of a row's ids."""
    path = path or public_tokenizers.path(RANKS)

    def rows_of(pieces: list[tuple[int, int, np.ndarray]], shard: int, first: int, kind: str) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for row, members in enumerate(best_fit([len(p[2]) for p in pieces], length), first):
            parts = [pieces[k] for k in members]
            cut = np.cumsum([0, *(len(p[2]) for p in parts)])
            ids = np.full(length, pad, kind)
            ids[: cut[-1]] = np.concatenate([p[2] for p in parts])
            at = np.zeros(length, "<u4" if length > 65_535 else "<u2")
            at[: cut[-1]] = np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))
            made = (shard, row, int(cut[-1]), len(parts), [p[0] for p in parts], [p[1] for p in parts], cut.tolist(), ids.tobytes(), at.tobytes())
            for c, x in zip(cols, made):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoding(path), TaskContext.get().partitionId()
        kind = "<u2" if enc.n_vocab <= 65_536 else "<u4"
        pieces, held, first = [], 0, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(encode_text(enc, text), kind)
                for k in range(0, len(ids), length):
                    pieces.append((doc, k, ids[k : k + length]))
                    held += len(pieces[-1][2])
                    if held >= WINDOW:
                        out = rows_of(pieces, shard, first, kind)
                        first += out.num_rows
                        pieces, held = [], 0
                        yield out
        if pieces:
            yield rows_of(pieces, shard, first, kind)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """doc_id, start, ids array<int>: the segments of packed rows, for round trips."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, ids = [], [], []
            for docs, starts, cut, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                row = np.frombuffer(raw, "<u4" if wide else "<u2")
                doc += docs
                start += starts
                ids += [row[a:z].astype(np.int32) for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return packed.select("doc_ids", "starts", "cu_seqlens", "ids").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
