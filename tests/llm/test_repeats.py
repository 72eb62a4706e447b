"""Operator 1 against brute force over every string."""

import hashlib
import random

import pytest

from heddle.llm.repeats import repeats

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, length=50):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if d is not None:
                least[s] = min(least.get(s, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            first = least.get(b[i : i + length])
            if first is not None and (d is None or first < d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(parts)
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats(df).collect()), key=str
    )


def made(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(40)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    passages = [prose(30) for _ in range(5)]
    rows = []
    for d in r.sample(range(-5, 10 * n), n):
        kind = r.random()
        text = prose(r.choice([0, 3, 12, 80, 300]))
        if kind < 0.4:
            at = r.randint(0, len(text))
            text = text[:at] + r.choice(passages)[r.randint(0, 20) :] + text[at:]
        elif kind < 0.6 and rows:
            text = r.choice(rows)[1] or ""
        elif kind < 0.7:
            text = "x" * r.choice([49, 50, 51, 700]) + text
        rows.append((d, text if kind < 0.97 else None))
    return [*rows, (None, rows[3][1]), (None, passages[0] * 2), rows[0], rows[5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, "a" * 50), (2, "b" + "a" * 50), (3, "a" * 49), (4, ""), (5, None), (6, "é" * 200), (7, "é" * 25 + "z" + "é" * 25)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_kept_bytes_and_spans(spark):
    rows = made(5)
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    text = dict(rows)
    for r in repeats(df, texts=True).collect():
        if r.doc_id is not None:
            whole = (text[r.doc_id] or "").encode()
            left, at = b"", 0
            for a, z in zip(r.starts, r.ends):
                left, at = left + whole[at:a], z
            assert left + whole[at:] == r.kept
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats(df).collect()), key=str)
    assert got == brute(rows)
