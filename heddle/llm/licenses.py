"""Licence scans with a positional rare-token index (operator 10).

Document frequencies of the templates' words over all documents give each template its
ANCHORS rarest words. The index maps such a word to (template, offset). In a document every
occurrence of an anchor proposes where a template would start; occurrences that agree on a
start intersect their postings by relative position. A proposed place is verified: the
template's mandatory phrase must stand where it belongs (within SLACK words) and COVERED of
the template's words must be found in order nearby. Base phrases are counted exactly.

Defined cases: a null or empty text has no words, null first_word and last_word, empty label
strings and score 0; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHORS, SLACK, COVERED = 4, 3, 0.7

# Base phrases and licence wordings with their mandatory phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)

WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(WORDS).split()


def frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents in all, and documents with each word of `vocabulary`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = 0, Counter()
        for b in batches:
            n += b.num_rows
            for t in b.column(0).to_pylist():
                of.update(vocabulary.intersection(words(t)))
        keys = [b"", *of]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n, *of.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' rarest words, and the verification of a proposed place."""

    def __init__(self, n: int, df: dict[bytes, int], templates=TEMPLATES):
        self.idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 0.5))
        self.templates = [(label, body.encode().split(), key.encode().split()) for label, body, key in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys = []
        for t, (_, body, key) in enumerate(self.templates):
            self.keys.append(next(i for i in range(len(body)) if body[i : i + len(key)] == key))
            rare = sorted(set(body), key=lambda w: (-self.idf(w), w))[:ANCHORS]
            for i, w in enumerate(body):
                if w in rare or w in key:
                    self.postings[w].append((t, i))
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]
        self.last = {p[-1] for p, _ in self.base}
        self.wanted = {*self.postings, *self.last}

    def scan(self, text: str | None) -> tuple:
        w = words(text)
        hits = [i for i, x in enumerate(w) if x in self.wanted]
        base, places, votes = set(), [], defaultdict(set)
        for i in hits:
            if w[i] in self.last:
                for p, label in self.base:
                    if i + 1 >= len(p) and w[i + 1 - len(p) : i + 1] == p:
                        base.add(label)
                        places.append(i + 1 - len(p))
            for t, at in self.postings.get(w[i], ()):
                votes[t, i - at].add(w[i])
        best: dict[str, float] = {}
        for (t, start), agreeing in sorted(votes.items(), key=lambda x: x[0]):
            label, body, key = self.templates[t]
            if len(agreeing) >= min(2, len(set(key))) and (got := self.verify(w, start, body, key, self.keys[t])) >= COVERED:
                best[label] = max(best.get(label, 0.0), got)
        labels = base | set(best)
        score = max([*best.values(), 0.6 if base else 0.0])
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)

    @staticmethod
    def verify(w: list[bytes], start: int, body: list[bytes], key: list[bytes], at: int) -> float:
        """Share of the template found in order from `start`; 0 without its mandatory phrase."""
        near = range(max(0, start + at - SLACK), start + at + SLACK + 1)
        if not any(w[k : k + len(key)] == key for k in near):
            return 0.0
        found, k = 0, max(0, start)
        for x in body:
            for j in range(k, min(len(w), k + SLACK + 1)):
                if w[j] == x:
                    found, k = found + 1, j + 1
                    break
        return found / len(body)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = {x for _, body, _ in templates for x in body.encode().split()}
    n, df = frequencies(docs, vocabulary, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(n, df, templates)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for b in batches:
            cols = list(zip(*(index.scan(t) for t in b.column(1).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
