"""Bounded BM25, hashed text vectors and the inverted file against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest

from heddle.operators import lexical as X
from heddle.operators import vectors as V


def bm25_case(n_rows=400, n_questions=25, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)]
    weight = 1 / np.arange(1, 121)
    texts = [Counter(rng.choice(words, int(rng.integers(3, 80)), p=weight / weight.sum()).tolist()) for _ in range(n_rows)]
    asked = {q: sorted(set(rng.choice(words, 6).tolist()) | {"w0", "w1"}) for q in range(n_questions)}
    return texts, asked


def plain_bm25(texts, asked, keep, least=1, only=None):
    often = Counter(w for t in texts for w in t)
    n, avg = len(texts), sum(sum(t.values()) for t in texts) / len(texts)
    idf = {w: max(math.log((n - c + 0.5) / (c + 0.5)), 1e-6) for w, c in often.items()}
    out = []
    for q, words in asked.items():
        scores = []
        for i, t in enumerate(texts):
            held = [w for w in words if w in t]
            if len(held) >= least and held and (only is None or i in only):
                dl = sum(t.values())
                scores.append((round(sum(idf[w] * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * dl / avg)) for w in held), 6), i))
        out += [(q, i, s, r) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize("keep,least,cut", [(5, 1, False), (5, 2, True), (1000, 1, False)])
def test_bounds_change_nothing(spark, keep, least, cut):
    texts, asked = bm25_case()
    matched = spark.createDataFrame([(i, w, c, sum(t.values())) for i, t in enumerate(texts) for w, c in t.items()], "rowid bigint, term string, tf bigint, dl bigint")
    corpus = spark.createDataFrame([(len(texts), sum(sum(t.values()) for t in texts) / len(texts))], "n_docs bigint, avgdl double")
    query = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid bigint, term string")
    weights = X.weighted(matched, corpus)
    only = set(range(0, 400, 3)) if cut else None
    search = X.Search(X.blocks(weights.where("rowid % 3 = 0") if cut else weights), query, keep, least=least)
    got = sorted((r.qid, r.rowid, round(r.score, 6), r["rank"]) for r in search.best().collect())
    assert got == plain_bm25(texts, asked, keep, least, only)
    if keep == 5 and not cut:
        every = query.join(weights, "term").select("qid", "rowid").distinct().count()
        assert search.candidates().count() < 0.4 * every


@pytest.mark.parametrize("value", [V.blake, V.md5])
def test_hashed_vectors(spark, value):
    texts = [None, "", "int Foo_bar(int x)  {\n return x;\n}", "汉字测试文本 token_a token_a", "long " * 3_000, "É ß"]
    got = {r.i: r for r in V.hashed(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", value).collect()}
    for i, t in enumerate(texts):
        want = [0] * V.DIM
        for f in V.features(t):
            h = value(f)
            want[h % V.DIM] += -1 if h & 1 else 1
        assert got[i].v == want and got[i].norm == sum(x * x for x in want)
    assert got[0].norm == got[1].norm == 0


def test_features():
    assert list(V.features("Ab  c9")) == ["t:ab", "t:c9", "c:ab ", "c:b c", "c: c9", "c:ab c", "c:b c9", "c:ab c9"]
    assert len([f for f in V.features("x" * 5_000) if f.startswith("c:")]) == 3 * V.HEAD_CHARS - 9


def structured(n=3_000, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim)) * 100
    return np.round(centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 25).astype(int)


def exact(x, q, keep):
    s = np.round((q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)), 6)
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -row))[:keep]] for row in s]


def test_inverted_file(spark):
    x = structured()
    x[100:140] = x[7]  # copies: ties go to the smaller id
    rows = spark.createDataFrame([(i, v.tolist(), int((v * v).sum())) for i, v in enumerate(x)] + [(9_999, [0] * 24, 0)], "id bigint, v array<bigint>, norm bigint")
    queries = rows.where("id % 100 = 7 or norm = 0").withColumnRenamed("id", "qid")
    index = V.InvertedFile(rows, cell_rows=100)
    want = exact(x, x[7::100], 10)
    plans = []
    for probe, least in ((None, 1.0), (6, 0.9)):
        found = index.nearest(queries, 10, probe)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.qid, []).append(r.id)
        assert 9_999 not in got
        recall = np.mean([len(set(got[7 + 100 * k]) & set(w)) / 10 for k, w in enumerate(want)])
        assert recall >= least
        if probe is None:
            assert [got[7 + 100 * k] for k in range(len(want))] == want
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_empty_index(spark):
    rows = spark.createDataFrame([(1, [0, 0], 0)], "id bigint, v array<bigint>, norm bigint")
    assert not V.InvertedFile(rows).nearest(rows.withColumnRenamed("id", "qid")).count()
