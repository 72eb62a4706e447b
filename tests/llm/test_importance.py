"""Importance resampling against a plain version, and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

from heddle.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(importance.UPPER, importance.LOWER)


def plain(docs, target, least=1, most=1, buckets=importance.BUCKETS, least_words=20, percent=10, seed=2024):
    def features(text):
        w = WORD.findall((text or "").translate(FOLD))
        return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = Counter(), Counter()
    for _, t in docs:
        own.update(map(at, features(t)[1]))
    for t in target:
        aim.update(map(at, features(t)[1]))
    s, t = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    rows = []
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain(at(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    eligible = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = eligible[: percent * len(eligible) // 100]
    places = [(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in eligible[len(drawn) :]]
    return Counter(places + [(*r[:4], None) for r in rows if r[4] < least_words])


def run(spark, docs, target, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS bucket", "1 AS gain", "2 AS feature", "3 AS digest")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return Counter(tuple(r) for r in importance.resample(d, t, **options).collect())


LONG = " ".join(f"wörd{i % 977} Common THE" for i in range(60_000))
DOCS = [(i, " ".join(f"W{(i * j) % 41}É" for j in range(15 + i % 17))) for i in range(120)]
DOCS += [(7, DOCS[7][1])] * 3 + [(200, None), (201, ""), (202, " .,!"), (None, DOCS[16][1]), (None, None), (203, LONG), (7, DOCS[8][1])]


def test_plain_version(spark):
    target = ["w3É w4É the common", None, "", "w3É"]
    assert run(spark, DOCS, target) == plain(DOCS, target)
    assert run(spark, DOCS, target, most=2, buckets=64, percent=55) == plain(DOCS, target, most=2, buckets=64, percent=55)


def test_only_a_to_z_is_lowered(spark):
    docs = [(1, "ÀÉ K Σ")]
    assert run(spark, docs, ["x"]) == plain(docs, ["x"])


def test_empty_tables(spark):
    assert not run(spark, [], ["a"])
    assert run(spark, DOCS[:30], []) == plain(DOCS[:30], [])


def test_more_partitions_than_one(spark):
    """Ranks stay 1, 2, 3 over a sort of many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, DOCS, ["w1É"], percent=100) == plain(DOCS, ["w1É"], percent=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
