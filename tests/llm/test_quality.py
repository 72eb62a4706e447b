"""Tokens, context sums and pooling against plain versions; calibration; held-out accuracy; defined cases."""

import re

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import quality as Q
from heddle.llm import queries

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


def plain_bucket(token: bytes) -> int:
    full, h = (1 << 64) - 1, 0
    for i, b in enumerate(token):
        h = (h + (b + 1) * pow(Q.ODD, i, 1 << 64)) & full
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & full
    h ^= h >> 32
    return (h * Q.ODD & full) >> 50


TEXTS = [b"", b"The cat!! sat, \xc3\xa9t\xc3\xa9", b"  \n ", b"one", b"a-b a--b\x7fc", b"x y " * 300, b"q" * 700]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_tokens(monkeypatch, size):
    monkeypatch.setattr(Q, "SLICE", size)
    for rows in (TEXTS, TEXTS[2:], [b""], []):
        bucket, first = Q.Tokens()(pa.array([b"cut", *rows], pa.binary())[1:])
        want = [[plain_bucket(t) for t in TOKEN.findall(x)] for x in rows]
        assert [list(bucket[a:z]) for a, z in zip(first, first[1:])] == want


def test_contexts_and_pooling(monkeypatch):
    monkeypatch.setattr(Q, "TOKENS", 16)
    bucket, first = Q.Tokens()(pa.array(TEXTS, pa.binary()))
    sums = np.zeros(Q.BUCKETS * Q.DIM)
    Q.contexts(bucket, first, sums)
    place, sign = Q.index_vectors()
    want = np.zeros((Q.BUCKETS, Q.DIM))
    for a, z in zip(first, first[1:]):
        for i in range(a, z):
            for j in range(max(a, i - Q.WINDOW), min(z, i + Q.WINDOW + 1)):
                if i != j:
                    np.add.at(want[bucket[i]], place[bucket[j]], sign[bucket[j]])
    assert np.array_equal(sums.reshape(want.shape), want)
    vectors = Q.normalised(want)
    got = Q.pooled(bucket, first, vectors)
    for k, (a, z) in enumerate(zip(first, first[1:])):
        v = vectors[bucket[a:z]]
        own = np.concatenate([v.mean(axis=0), np.sqrt((v * v).mean(axis=0))]) if z > a else np.zeros(2 * Q.DIM)
        assert np.allclose(got[k], own)


def test_temperature_lowers_the_loss_of_rows_kept_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = Q.train(x, y, np.ones(600))
    back = np.arange(600) % 5 == 4
    z = net.logits(x[back])
    assert Q.loss(z / net.temperature, y[back], np.ones(back.sum())) <= Q.loss(z, y[back], np.ones(back.sum()))
    assert net.temperature > 1  # noisy labels: the bare network is too sure
    assert ((net(x) >= 0.5) == y).mean() > 0.7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op13_quality(spark, sf).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    for wanted in (0, 1):
        own = [r["predicted"] == wanted for r in rows if r["quality"] == wanted]
        assert np.mean(own) >= 0.9


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "some words"), (3, "w " * 200_000)], "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS n_tokens", "3 AS y")
    labels = spark.createDataFrame([(1, 1), (2, 1), (1, 0), (None, 0), (3, None)], "doc_id bigint, quality int")
    vectors = Q.word_vectors(docs)
    got = Q.score(docs, vectors, Q.fit(docs, labels, vectors)).collect()
    assert sorted((r["doc_id"] or 0, r["score"], r["n_tokens"]) for r in got) == [(0, 0.75, 2), (1, 0.75, 0), (1, 0.75, 0), (2, 0.75, 0), (3, 0.75, 200_000)]
    none = docs.limit(0)
    assert not Q.score(none, Q.word_vectors(none), Q.fit(none, labels, vectors)).count()


def test_vectors_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert np.array_equal(Q.word_vectors(docs), Q.word_vectors(docs.repartition(7)))
