"""Language identification by rank-order n-gram profiles (operator 6).

A profile is a language's TOP most frequent letter n-grams (n = 1 to 3, words joined by
one space) in rank order. A document is compared with each profile by the out-of-place
distance: the sum of rank differences of the document's own TOP n-grams, TOP for one the
profile lacks. Three code points fit 63 bits, so n-grams are exact integers, not hashes.

Learning takes at most `per_lang` rows of each language, chosen by a hash of the id (a
documented bound; prediction reads every whole text). Defined cases: `und` with score 0
where the text is null or has no letter, or where nothing could be learned; ties go to
the alphabetically first language; repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import sample_share

TOP = 400
PER_LANG = 2_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as integers of up to three 21-bit code points; empty without letters."""
    words = LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    return np.concatenate([c, two, (two[:-1] << 21) | c[2:]])


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The `top` keys by falling count, ties by key."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:top]


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = PER_LANG, top: int = TOP) -> dict[str, list[int]]:
    """Language -> its n-grams in rank order; counts are summed by Spark over the sampled rows."""
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col(lang_col) == lang) & sample_share(F.col(id_col), min(1.0, per_lang / n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(lang, []).append(grams(text))
            for lang, parts in of.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = (
        train.where(wanted).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in counted.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """The profiles as one table of ranks, and the nearest profile of a text."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.top, self.langs = top, sorted(profiles)
        self.vocab = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.place = np.full((len(self.vocab), len(self.langs)), top, np.int32)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.vocab, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        g, top = grams(text), self.top
        if not len(g) or not self.langs:
            return "und", 0.0
        if not len(self.vocab):
            return self.langs[0], 0.5
        own = ranked(*np.unique(g, return_counts=True), top)
        at = np.minimum(np.searchsorted(self.vocab, own), len(self.vocab) - 1)
        known = self.vocab[at] == own
        near = self.place[at[known]]
        far = np.where(near == top, top, np.abs(near - np.arange(len(own))[known, None])).sum(axis=0) + top * int((~known).sum())
        order = np.argsort(far, kind="stable")
        first = float(far[order[0]])
        second = float(far[order[1]]) if len(self.langs) > 1 else float(top * len(own))
        return self.langs[order[0]], second / (first + second) if first + second else 0.5


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """id_col, lang_pred, score: the nearest profile; score = second distance / (first + second)."""
    judge = Judge(profiles, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def kept(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """The rows of `docs`, whole, whose language isn't `und`; without profiles, those with a letter."""
    judge = Judge(profiles or {"any": []}, top)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t)[0] != "und" for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
