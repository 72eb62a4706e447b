"""Operators 3, 6, 7 and 10 on planted cases, odd rows and held-out rows."""

import random
import re

from pyspark.sql import functions as F

from heddle.llm import decontaminate, langid, licenses, queries, toxicity

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "12 34 !!"), (9005, "x" * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "c1", "c2", "c3") for d, t in rows], "doc_id bigint, text string, id string, score string, label string").repartition(3)


def test_contaminated_documents_are_found(spark, sf):
    r = random.Random(1)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = sorted({w for _, t in items for w in t.split()})
    prose = lambda k: " ".join(r.choices(words, k=k))
    rows, want = [], {}
    for n, (i, t) in enumerate(items):
        edited = list(t)
        for _ in range(int(len(t) * 0.05)):
            edited[r.randrange(len(edited))] = r.choice("abcdefgh ")
        rows += [(10 * n, f"{prose(80)} {t.upper()} {prose(80)}"), (10 * n + 1, f"{prose(30)} {''.join(edited)} {prose(40)}"), (10 * n + 2, prose(120))]
        want |= {10 * n: i, 10 * n + 1: i}
    bench = spark.createDataFrame([*items, (None, None), (-1, None), (-2, "")], "item_id bigint, text string")
    got = {x.doc_id: x["items"] for x in decontaminate.contaminated(frame(spark, [*rows, *ODD]), bench).collect()}
    assert sum(want[d] in got.get(d, []) for d in want) >= 0.98 * len(want)
    assert not set(got) - set(want)
    assert decontaminate.contaminated(frame(spark, []), bench).collect() == []
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).collect() == []


def test_edit_search_is_exact():
    r = random.Random(2)
    for _ in range(200):
        item, text = ("".join(r.choices("abc", k=r.randint(1, n))) for n in (12, 30))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        best = min(row)
        got = decontaminate.edit_search(item, text, len(item))
        assert got[0] == min(best, len(item))


def test_language_of_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_langid(spark, sf.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog"), (2, "der hund und die katze"), (1, "the cat and the dog"), *ODD]
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "de"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.learn(df)).collect()}
    assert got[1] == "en" and got[2] == "de" and {got[k] for k in (9001, 9002, 9003, 9004)} == {"und"}
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.learn(df.limit(0)) == {}


def test_toxicity_of_held_out_rows(spark, sf):
    at = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = queries.op7_toxicity(spark, at).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    recall = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    alarms = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    print("toxicity", recall, alarms)
    assert recall >= 0.85 and alarms <= 0.05


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "you are an idiot"), (2, "a nice day"), (3, "he said you are not an idiot"), *ODD]
    df = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, none)).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and 0 <= got[9001].score == got[9002].score < 0.5
    assert got[3].score < got[1].score


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, sf):
    rows = [(1, "Released under the MIT License."), (2, "mit-license; Apache\nLicense and the GNU general public license"), (3, "permission is granted"), (1, "Released under the MIT License."), *ODD]
    rows += [(100 + i, body) for i, (_, body, _) in enumerate(licenses.TEMPLATES)]
    rows += [(r.doc_id + 20_000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[100 + i].labels.split(",")
    assert got[9001].labels == "" and got[9001].score == 0
    assert licenses.scan(frame(spark, [])).collect() == []
