"""Batches of questions: texts are read on all cores, features are hashed once, both lexical lanes come from one pass."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle.operators import retrieval as R
from heddle.operators import vectors as V
from heddle.plans import facts


def test_one_row_group_is_read_by_many_tasks(spark, sf, tmp_path):
    draw = random.Random(1)
    texts = ", ".join(f"({i}, '{draw.randbytes(2_500).hex()}', 'web', 'en')" for i in range(2_000))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {texts}) t(doc_id, text, source, lang)) TO '{tmp_path}/documents.parquet'")
    os.symlink(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    rows = facts.shown(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.length("text"))).collect()
    assert len(rows) >= 4 and 0 < sum(r.n for r in rows) <= 2_000


@pytest.mark.parametrize("value", [V.blake, V.md5])
def test_features_of_a_batch(value):
    draw = random.Random(0)
    wide = ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(1_900)) for _ in range(6)]  # together too many characters for one number a gram
    texts = [None, "", "a", "ab", "abc", " a\n\n b ", "İ ſ ß É", "汉字" * 3_000, *wide, "".join(chr(draw.randrange(0x10000, 0x1FFFF)) for _ in range(2_500)), "ab_c ab_c " * 400]
    calls = []
    got = V.signed_counts(texts, lambda f: (calls.append(f), value(f))[1])
    for row, text in zip(got.tolist(), texts, strict=True):
        want = [0] * V.DIM
        for f in V.features(text):
            h = value(f)
            want[h % V.DIM] += -1 if h & 1 else 1
        assert row == want
    assert len(calls) == len(set(calls)) == len({f for t in texts for f in V.features(t)})
    assert V.signed_counts([], value).shape == (0, V.DIM)


def test_lexical_lanes(spark):
    draw = random.Random(2)
    rows = [(q, r, draw.randrange(1, 4), draw.randrange(20) / 4) for q in range(5) for r in range(100) if draw.random() < 0.8]
    scores = spark.createDataFrame(rows, "qid bigint, rowid bigint, hits bigint, score double")
    cards = spark.createDataFrame([(r,) for r in range(0, 100, 3)], "rowid bigint")
    both = R.lexical_lanes(scores, cards)
    for lane, want in (("text", R.bm25(scores)), ("card", R.card_lane(scores, cards))):
        got = both.where(F.col("lane") == lane).select("qid", "rowid", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("qid", "rowid", "score", "rank").collect()))


def test_lines_are_dealt_once(spark, sf):
    for rows, shuffles in ((facts.edge_obs(spark, sf), 1), (facts.typed(spark, sf), 2)):  # the second also for distinct rows
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles


def test_links(spark, sf):
    meta = facts.meta(spark, sf)
    ids = {r.rowid for r in meta.select("rowid").collect()}
    want = sorted((r.src, r.dst) for r in facts.certain(spark, sf).collect() if r.src in ids and r.dst in ids)
    assert sorted(map(tuple, facts.links(spark, sf, meta).collect())) == want and want
