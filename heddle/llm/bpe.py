"""Byte-level BPE encoding and decoding with a local rank file (operator 5).

Each task builds one tiktoken Encoding per Python worker and keeps it. Texts longer
than LONG characters are cut at safe boundaries first: a single space between two
word characters. The pattern's matches never run past a word into the following
space, and it looks behind nothing, so the pieces' ids joined are the whole text's.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows
are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 16_384
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The Encoding of a rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> list[str]:
    """`text` cut at safe boundaries into pieces of about `long` characters."""
    if len(text) <= long:
        return [text]
    cuts, at = [0], long
    while at < len(text) and (m := SAFE.search(text, at)):
        cuts.append(m.start())
        at = m.start() + long
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: the token ids of each whole text."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = [encode_text(enc, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, bytes binary: the raw bytes of each row's ids; they need not be valid UTF-8."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    kind = ids.schema[id_col].dataType.simpleString()
    out = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, round_trip: digests of ids and of the bytes they decode to; or the ids too.

    One pass encodes and decodes, so that ids do not travel between two Python stages.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n, ids_sha, raw_sha, same, kept = [], [], [], [], []
            for text in b.column(1).to_pylist():
                ids = encode_text(enc, text)
                raw = enc.decode_bytes(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == (text or "").encode())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.list_(pa.int32()))] if with_ids else cols, [*names, "ids"] if with_ids else names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    )
    return out.withColumnRenamed("id", id_col)
