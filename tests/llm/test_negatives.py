"""Hard negatives against brute force on structured, unstructured, repeated and invalid vectors."""

import math

import numpy as np
import pytest

from heddle.llm import negatives as N

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def plain(rows, anchors, k=5, positives=5, percent=80, scale=256):
    fine = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    unique = sorted({(i, lab, tuple(math.floor(scale * c) for c in v)) for i, lab, v in fine})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in unique:
        if i in anchors:
            scored = sorted((-dot(v, w), j, other) for j, other, w in unique if j != i)
            for s, j, _ in [r for r in scored if r[2] == lab][:positives]:
                near = [(-n, m) for n, m, other in scored if other != lab and percent * -s <= 100 * -n <= 100 * -s][:k]
                out += [(i, j, rank, m, -s, n) for rank, (n, m) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS key")
    return sorted(tuple(r) for r in N.hard_negatives(df, df.where(df["vec_id"].isin(*anchors) if anchors else "false"), **options).collect())


def clustered(n=900, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim)) * 3
    return [(i, int(rng.integers(0, 4)), (centre[i % 12] + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize("leaf", [512, 16])
def test_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    monkeypatch.setattr(N, "PACK", 7)
    rows = clustered()
    assert run(spark, rows, set(range(0, 900, 31)), block_rows=60) == plain(rows, set(range(0, 900, 31)))


def test_copies_ties_and_repeated_ids(spark):
    rows = clustered(200, 4)
    rows += [(1_000 + i, i % 3, [1.0, 2.0, 0.5, 0.0]) for i in range(400)] + [rows[0], rows[0], (5, 1, [9.0, 1.0, 1.0, 1.0]), (0, 2, [0.0, 0.0, 0.0, 0.0])]
    asked = {0, 5, 100, 1_000, 1_001}
    assert run(spark, rows, asked, block_rows=40) == plain(rows, asked)


def test_invalid_rows_and_odd_lengths(spark):
    rows = clustered(60, 3)
    rows += [(None, 1, [1.0, 1.0, 1.0]), (70, None, [1.0, 1.0, 1.0]), (71, 1, None), (72, 1, [1.0, None, 1.0]), (73, 2, [1.0, float("nan"), 1.0]), (74, 2, [float("inf"), 0.0, 0.0]), (75, 1, []), (76, 2, [2.0, 2.0]), (77, 3, [1.0, 1.0, 1.0, 8.0])]
    asked = {0, 10, 70, 71, 72, 73, 74, 75, 76, 77}
    assert run(spark, rows, asked) == plain(rows, asked)


def test_components_beyond_exact_doubles(spark):
    rows = [(i, i % 2, [float(1 << 30) + i, float(i), 1.0]) for i in range(12)]
    rows = [(i, lab, [c / 256 for c in v]) for i, lab, v in rows]
    assert run(spark, rows, {0, 4, 7}) == plain(rows, {0, 4, 7})
    assert run(spark, [(1, 0, [1e300]), (2, 0, [1e300]), (3, 1, [1e300])], {1})  # saturated


def test_no_rows(spark):
    assert not run(spark, [], {1})
    assert not run(spark, clustered(20), set())
    assert not run(spark, [(1, 0, [1.0]), (2, 1, [1.0])], {1, 2})  # no positives


def test_leaves_are_pruned():
    """On clustered vectors most leaves lie outside the annulus."""
    rows = clustered(4_000, 8, 3)
    x = np.floor(256 * np.array([v for _, _, v in rows]))
    space = N.Space(float((x * x).sum(axis=1).max()), 8)
    tree = N.Tree(space, x, 64)
    opened = []
    score = space.score
    space.score = lambda a, q: opened.append(len(a)) or score(a, q)
    ids, labels = np.arange(len(x)), np.array([lab for _, lab, _ in rows])
    q = np.arange(0, 4_000, 400)
    none = np.array([[N.LEAST]] * len(q))
    got = list(N.first_in_windows(tree, x, ids, labels, x[q], ids[q], labels[q], none, np.array([[N.MOST]] * len(q)), True, 5))
    assert len(got) == len(q)
    assert sum(opened[1:]) < 0.3 * len(x) * len(q)
