"""Operator 9 against brute force over all pairs."""

import random
import re

from heddle.llm.minhash import near_duplicates

SCHEMA = "doc_id bigint, text string, id string, n string"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, size, percent):
    rows = sorted({d: t for d, t in rows}.items())
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(d, len(sets[i]), rows[root(i)][0], root(i) == i) for i, (d, _) in enumerate(rows)]


def run(spark, rows, size=3, percent=85):
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA).repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, size, percent).collect())


def test_against_brute_force(spark):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgÉ", k=r.randint(1, 7))) for _ in range(400)]
    base = [r.choices(words, k=k) for k in (3, 30, 80, 200)]
    rows = []
    for d in r.sample(range(-9, 500), 120):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((d, " ".join(w).upper() if r.random() < 0.2 else " \t".join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), rows[0]]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)
