"""Operator 4 with DataFrame operations only; bands that stars settle; files that go."""

import os
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import blocks, components, lines, minhash
from heddle.llm.common import shared_dir

SCHEMA = "doc_id bigint, text string"


def grams(x):
    return {x[i : i + 5] for i in range(max(1, len(x) - 4))}


def made(seed):
    r = random.Random(seed)
    base = ["".join(r.choices(a, k=n)) for a, n in (("abcdefghij ", 60), ("ae ", 300), ("\U0001f600\U0001f601\U0001f602xyz", 80), ("abcdefghijklmnop ", 500), ("abcdefghijklmnop ", 230))]
    out = []
    for x in base * 6:
        k = r.randrange(1, len(x) - 1)
        out.append((x[:k] + r.choice("qrs\U0001f603") + x[k + 1 :]).strip())
    return list(dict.fromkeys(out))


def test_no_python_on_executors(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on executors")

    for way in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(DataFrame, way, refused)
    texts = made(1)
    rows = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    want = {i for i, x in enumerate(texts) if not any(100 * len(grams(x) & grams(y)) >= 80 * len(grams(x) | grams(y)) for y in texts[:i])}
    assert {r.doc_id for r in rows if r.text} == want


def test_prefixes_lose_no_link(spark):
    r = random.Random(7)
    base = made(3)
    texts = sorted({x[: r.randint(len(x) * 3 // 4, len(x))].strip() for x in base for _ in range(3)} | {"abcd", "abcde", "abcdef"})
    rows = spark.createDataFrame([(i, x, len(grams(x))) for i, x in enumerate(texts)], "id bigint, norm string, n int")
    mixed = rows.select(F.lit(1).alias("key"), "id", F.col("id").alias("comp"))
    found = blocks.Forest(len(texts))
    links = lines.within(mixed, rows, 80).collect()
    for a, b in links:
        found.join(a, b)
    near = lambda a, b: 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b))
    want = blocks.Forest(len(texts))
    for j in range(len(texts)):
        for i in range(j):
            if near(texts[i], texts[j]):
                want.join(i, j)
    assert all(near(texts[a], texts[b]) for a, b in links) and links
    assert [found.root(i) for i in range(len(texts))] == [want.root(i) for i in range(len(texts))]


def test_stars_settle_small_bands(spark):
    held = spark.createDataFrame([(k, b"%d" % i) for k, members in enumerate([(1, 2), (3, 4, 5), (1, 6, 7, 8)]) for i in members], "key bigint, id binary")
    compared, none = [], spark.createDataFrame([], "a binary, b binary")

    def verified(pairs):
        compared.extend((bytes(a), bytes(b)) for a, b in pairs.collect())
        return none

    def rest(mixed):
        raise AssertionError("every pair has been compared")

    assert components.classes(held, verified, rest).count() == 0
    assert len(compared) == len(set(compared)) == 1 + 3 + 6


def test_only_results_stay_in_the_shared_folder(spark):
    docs = spark.createDataFrame([(i, x + " and some more words of it") for i, x in enumerate(made(2))], SCHEMA)
    there = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(there))
    lines.removals(docs)
    minhash.near_duplicates(docs)
    assert sorted(x.split("-")[0] for x in set(os.listdir(there)) - before) == ["marked", "removals"]
