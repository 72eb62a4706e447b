"""Operators 5 and 8: ids against the tiktoken library on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers

from heddle.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(3)
    words = ["the", "naïve", "Straße", "don't", "été", "日本", "x1", "--", "\n\n", "  ", "1234567", "...", "\t", "I'll", "👍🏽", " "]
    out = [None, "", " ", "a", "a" * 40_000, " " * 40_000, "word " * 20_000]
    for n in (10, 500, 9_000):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "", "\n"]) for _ in range(n)))
    return out


def test_ids_and_bytes(spark):
    enc = bpe.encoding(PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in [*rows, rows[3]]], "doc_id bigint, text string, id string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(bpe.encode(df)).collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip(df.limit(0)).collect() == []


def test_cut_texts_encode_the_same(spark):
    enc = bpe.encoding(PATH)
    r = random.Random(5)
    for _ in range(20):
        t = "".join(r.choice(["ab", "é", " ", "  ", "'s", "1", ".", "\n", "Zz"]) for _ in range(3_000))
        parts = bpe.pieces(t, 50)
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_packing_is_lossless(spark):
    enc = bpe.encoding(PATH)
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    packed = packing.pack(df, length=512).cache()
    for r in packed.collect():
        cut, ids, at = r.cu_seqlens, np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(at) == 512 and cut[0] == 0 and cut[-1] == r.n_tokens <= 512 and len(cut) == r.n_segments + 1
        assert at[: cut[-1]].tolist() == [k for a, z in zip(cut, cut[1:]) for k in range(z - a)]
    back = {}
    for r in packing.unpack(packed).orderBy("doc_id", "start").collect():
        assert r.start == len(back.get(r.doc_id, []))
        back.setdefault(r.doc_id, []).extend(r.ids)
    assert back == {i: enc.encode_ordinary(t) for i, t in rows if t}
    assert packing.pack(df.limit(0)).collect() == []


def test_best_fit_fills_the_fullest_row():
    r = random.Random(1)
    for _ in range(20):
        sizes = [r.randint(1, 64) for _ in range(r.randint(0, 200))]
        rows = packing.best_fit(sizes, 64)
        assert sorted(k for row in rows for k in row) == list(range(len(sizes)))
        left, want = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [x for x in left if x >= sizes[k]]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - sizes[k])
            else:
                left.append(64 - sizes[k])
        assert sorted(64 - sum(sizes[k] for k in row) for row in rows) == sorted(left)
