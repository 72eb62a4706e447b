"""Operator 2: recall and exact scores against brute force."""

import numpy as np

from heddle.llm.ann import nearest

SCHEMA = "vec_id bigint, embedding array<float>, id string, v string"


def run(spark, rows, asked, k=20, **more):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in nearest(df, df.where(f"vec_id in ({','.join(map(str, asked))})"), k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def exact(rows, q, k=20):
    by = dict(rows)
    far = sorted((-float(np.dot(np.array(by[q], float), np.array(v, float))), i) for i, v in rows if i != q)
    return [i for _, i in far[:k]]


def test_small_and_odd(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0])]
    got = run(spark, rows, [1, 2, 4, 5])
    assert [x[1] for x in got[1]] == [2, 3, 9] and [x[1] for x in got[2]] == [1, 3, 9] and set(got) == {1, 2}
    assert run(spark, rows[:1], [1]) == {}


def test_recall_on_the_test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = [len(set(got[q]) & set(exact(rows, q))) / 20 for q, _ in rows if q % 20 == 0]
    assert np.mean(hits) >= 0.9


def test_forest_on_unstructured_vectors(spark):
    x = np.random.default_rng(2).normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = list(range(0, 3000, 100))
    got = run(spark, rows, asked, sample=1500, leaf=24, probe=600)
    assert np.mean([len({v for _, v, _ in got[q]} & set(exact(rows, q))) / 20 for q in asked]) >= 0.9


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.9, float(i) / 100]) for i in range(5)]
    got = run(spark, rows, [50, 3])
    assert [v for _, v, _ in got[50]] == list(range(20)) and [v for _, v, _ in got[3]] == [i for i in range(21) if i != 3]
