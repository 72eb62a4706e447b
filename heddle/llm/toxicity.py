"""Toxicity by a weighted finite-state pattern grammar (operator 7).

Four weighted transducers read a clause and are composed; a path adds up, over the words, the
product of the four weights, and a clause scores its best path:

1. lexicon: words -> symbols: hit (an insult or threat, with its weight), target, negation,
   report, other; a threat of two words has a state between them;
2. negation: hits within NEG_SPAN words after a negation weigh NEGATED;
3. reported speech: after a reporting word the rest of the clause's hits weigh REPORTED;
4. target: hits within TARGET_SPAN words of a target, before or after it, weigh AIMED; a hit
   before its target is a guess that only reaches a final state if the target comes.

What is scored are whole clauses, from break to break however far, not single words; the
document's sum over clauses goes through a logistic function. Only clauses with an insult or
threat are walked; one regular expression over learned and seeded patterns finds them.

Learning: from about `per_class` labelled rows of each class chosen by a hash of the id (a
documented bound), words and word beginnings (3 to 8 letters) that mark toxic documents
become hits weighted by log-odds: all that occur in SUPPORT of them and are LEAST_PRECISION
precise, of which there cannot be more than features of a document / SUPPORT. The two
logistic parameters are then fitted. Defined cases: null and empty texts score what an empty
text scores; without labelled rows of both classes the seed words and DEFAULT parameters
hold; repeated rows are scored each; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialize, sample_share

PER_CLASS = 6_000
NEG_SPAN, TARGET_SPAN = 3, 4
NEGATED, REPORTED, AIMED = 0.7, 0.8, 1.5
SEED_WEIGHT, DEFAULT, KNEE = 3.0, (-2.5, 1.0), 3.5
LEAST_DOCS, SUPPORT, LEAST_PRECISION, SPECIFIC = 3, 0.004, 0.9, 0.9
HIT, TARGET, NEGATION, REPORT, OTHER = "hit", "target", "negation", "report", "other"
SYMBOLS = (HIT, TARGET, NEGATION, REPORT, OTHER)

# Fixed word lists of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile")
THREATS = ("kill you", "hurt you", "destroy you", "hunt you", "beat you")
TARGETS = frozenset("you your yourself he she they them people du ihr dich euch tu vous toi usted ustedes tú".split())
NEGATIONS = frozenset("not never no isn't aren't don't nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says wrote claimed called quoted sagte schrieb disait dijo escribió".split())

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
BREAK = re.compile(r"[.!?;:\n]")


def squash(raw):
    """Sums over KNEE, about one match, count a tenth: the first match decides, more only add certainty."""
    return np.minimum(raw, KNEE) + 0.1 * np.maximum(np.asarray(raw, float) - KNEE, 0)


@dataclass
class Model:
    """Patterns (a word, or a beginning marked by a final *) with weights, and the logistic parameters."""

    weights: dict[str, float] = field(default_factory=lambda: {**dict.fromkeys(INSULTS, SEED_WEIGHT), **dict.fromkeys(THREATS, SEED_WEIGHT)})
    logistic: tuple[float, float] = DEFAULT


class Transducer:
    """States, final states, and arcs: (state, symbol read) -> (next state, symbol written, weight) of each arc."""

    def __init__(self, start, finals: Iterable, arcs: dict[tuple, list[tuple]]):
        self.start, self.finals, self.arcs = start, frozenset(finals), arcs


def compose(one: Transducer, two: Transducer, symbols: tuple[str, ...] = SYMBOLS) -> Transducer:
    """The transducer that reads what `one` reads and writes what `two` writes of it; weights multiply."""
    start = (one.start, two.start)
    arcs, seen, todo = {}, {start}, deque([start])
    while todo:
        a, b = state = todo.popleft()
        for read in symbols:
            found = [((p, q), out, v * w) for p, mid, v in one.arcs.get((a, read), ()) for q, out, w in two.arcs.get((b, mid), ())]
            if found:
                arcs[state, read] = found
                new = {to for to, *_ in found} - seen
                seen |= new
                todo.extend(sorted(new))
    return Transducer(start, {(a, b) for a, b in seen if a in one.finals and b in two.finals}, arcs)


def negation() -> Transducer:
    """A state is the number of words that the last negation still reaches."""
    arcs = {}
    for s in range(NEG_SPAN + 1):
        for x in SYMBOLS:
            arcs[s, x] = [(NEG_SPAN if x == NEGATION else max(0, s - 1), x, NEGATED if x == HIT and s else 1.0)]
    return Transducer(0, range(NEG_SPAN + 1), arcs)


def reported() -> Transducer:
    """State 1 is behind a reporting word."""
    arcs = {(s, x): [(int(s or x == REPORT), x, REPORTED if x == HIT and s else 1.0)] for s in (0, 1) for x in SYMBOLS}
    return Transducer(0, (0, 1), arcs)


def aimed() -> Transducer:
    """A state holds the words that the last target still reaches, and those within which a guessed one must come (0: none)."""
    arcs = {}
    for after in range(TARGET_SPAN + 1):
        for due in range(TARGET_SPAN + 1):
            for x in SYMBOLS:
                if x == TARGET:
                    arcs[(after, due), x] = [((TARGET_SPAN, 0), x, 1.0)]
                    continue
                left = max(0, after - 1)
                on = [] if due == 1 else [((left, max(0, due - 1)), x, AIMED if x == HIT and after else 1.0)]
                if x == HIT and not after and due != 1:
                    on.append(((left, due - 1 if due else TARGET_SPAN), x, AIMED))
                if on:
                    arcs[(after, due), x] = on
    return Transducer((0, 0), {(after, 0) for after in range(TARGET_SPAN + 1)}, arcs)


def numbered(t: Transducer) -> Transducer:
    """The same transducer with whole numbers as states."""
    names = {s: k for k, s in enumerate(dict.fromkeys([t.start, *(s for s, _ in t.arcs), *(a[0] for found in t.arcs.values() for a in found)]))}
    return Transducer(names[t.start], (names[s] for s in t.finals if s in names), {(names[s], x): [(names[to], out, w) for to, out, w in found] for (s, x), found in t.arcs.items()})


CONTEXT = numbered(compose(compose(negation(), reported()), aimed()))


class Lexicon:
    """The first transducer: reads words. State 0 is between patterns; (p, k) has read k words of the phrase p."""

    def __init__(self, weights: dict[str, float]):
        self.whole = {p: w for p, w in weights.items() if p[-1:] != "*" and " " not in p}
        self.begins = {p[:-1]: w for p, w in weights.items() if p[-1:] == "*"}
        self.phrases = {tuple(p.split()): w for p, w in weights.items() if " " in p}

    def arcs(self, state, word: str) -> list[tuple]:
        if state:
            phrase, k = state
            if word != phrase[k]:
                return []
            return [(0 if k + 1 == len(phrase) else (phrase, k + 1), self.symbol(word), 0.0)]
        found = max([self.whole.get(word, 0.0), *(self.begins.get(word[:k], 0.0) for k in range(3, min(len(word), 8) + 1))])
        out = [(0, HIT, found) if found else (0, self.symbol(word), 0.0)]
        return out + [((p, 1), HIT, w) for p, w in self.phrases.items() if p[0] == word and w > found]

    @staticmethod
    def symbol(word: str) -> str:
        return TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER


class Grammar:
    """The composed transducers of a model."""

    def __init__(self, model: Model):
        self.a, self.b = model.logistic
        self.lexicon = Lexicon(model.weights)
        firsts = sorted({*self.lexicon.whole, *(" ".join(p) for p in self.lexicon.phrases)})
        both = [*(rf"{re.escape(x)}(?![^\W_])" for x in firsts), *(re.escape(x) for x in sorted(self.lexicon.begins))]
        self.find = re.compile(rf"(?<![^\W_])(?:{'|'.join(both)})") if both else None

    def clause(self, words: list[str]) -> float:
        """The weight of the clause's best path through the composition of the lexicon with CONTEXT."""
        best = {(0, CONTEXT.start): 0.0}
        for word in words:
            then: dict[tuple, float] = {}
            for (a, b), total in best.items():
                for p, symbol, v in self.lexicon.arcs(a, word):
                    for q, _, w in CONTEXT.arcs.get((b, symbol), ()):
                        if total + v * w > then.get((p, q), -1.0):
                            then[p, q] = total + v * w
            best = then
        return max((v for (a, b), v in best.items() if a == 0 and b in CONTEXT.finals), default=0.0)

    def matched(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and weight of each clause with an insult or threat."""
        text = (text or "").lower().replace("\u2019", "'")
        found, end, breaks = [], 0, None
        for m in self.find.finditer(text) if self.find and text else ():
            if m.start() < end:
                continue
            if breaks is None:
                breaks = [x.end() for x in BREAK.finditer(text)]
            k = bisect_right(breaks, m.start())
            start = breaks[k - 1] if k else 0
            stop = BREAK.search(text, m.end())
            end = stop.start() if stop else len(text)
            found.append((start, end, self.clause(WORD.findall(text[start:end]))))
        return found

    def raw(self, text: str | None) -> float:
        return sum(w for *_, w in self.matched(text))

    def score(self, text: str | None) -> float:
        z = self.a + self.b * float(squash(self.raw(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in range(3, min(len(w), 8) + 1)}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """A model from labelled rows: patterns by log-odds, then the logistic parameters.

    The sample is drawn from `labels` first; its ids, about `per_class` of each class at any
    size of the input, are broadcast, so texts are not shuffled.
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in labels.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    share = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    drawn = labels.where(sample_share(F.col(id_col), share[0]) & (F.col("y") == 0) | sample_share(F.col(id_col), share[1]) & (F.col("y") == 1))
    texts = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null")
    sample = materialize(texts.join(F.broadcast(drawn), id_col).select("y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of[y].update(features(text))
        keys = [k for k in of[1] if of[1][k]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([of[1][k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], ["f", "pos", "neg"])
        yield pa.RecordBatch.from_arrays([pa.array(list(of[0]), pa.string()), pa.array([0] * len(of[0]), pa.int64()), pa.array(list(of[0].values()), pa.int64())], ["f", "pos", "neg"])

    n_pos, n_neg = sizes[1] * share[1], sizes[0] * share[0]
    # A feature's documents in the whole of both classes, estimated from the samples.
    pos, neg = F.col("pos") / share[1], F.col("neg") / share[0]
    marks = (
        sample.mapInArrow(count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") >= max(LEAST_DOCS, SPECIFIC * SUPPORT * n_pos)) & (pos >= LEAST_PRECISION * (pos + neg))).collect()
    )
    model = Model()
    seeds = dict(model.weights)
    model.weights = {**seeds, **specific({r["f"]: (r["pos"], r["neg"]) for r in marks}, n_pos, n_neg)}
    grammar = Grammar(model)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grammar.raw(t) for t in b.column(1).to_pylist()], pa.float64())], ["y", "raw"])

    got = sample.mapInArrow(raws, "y int, raw double").collect()
    y = np.array([r["y"] for r in got], float)
    x = squash(np.array([r["raw"] for r in got], float))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    model.logistic = logistic(x, y, weight / weight.mean())
    return model


def specific(marks: dict[str, tuple[int, int]], n_pos: float, n_neg: float) -> dict[str, float]:
    """The marks worth keeping, each as its most specific form, with weights.

    A mark gives way to the longest one under it that occurs in nearly (SPECIFIC) as many
    toxic documents, so a beginning is used only where the endings vary.
    """
    chosen: dict[str, float] = {}
    for f in sorted(marks, key=lambda x: (-marks[x][0], len(x), x)):
        pos, neg = marks[f]
        if pos < max(LEAST_DOCS, SUPPORT * n_pos) or any(f.startswith(p[:-1]) if p[-1] == "*" else f == p for p in chosen):
            continue
        if f[-1] == "*":
            under = [g for g in marks if g.startswith(f[:-1]) and marks[g][0] >= SPECIFIC * pos]
            f = max(under, key=lambda g: (len(g.rstrip("*")), g[-1] != "*", g))
            pos, neg = marks[f]
        odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
        chosen[f] = round(odds / 2, 6)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge; the slope stays positive."""
    t = np.array([-1.0, 0.5])
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ t, -30, 30)))
        g = m.T @ (weight * (p - y)) + ridge * len(x) * 0.01 * t
        h = (m * (weight * p * (1 - p))[:, None]).T @ m + np.eye(2) * ridge * len(x) * 0.01
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0]), float(max(t[1], 1e-3))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted, n_clauses: whole texts scored by the grammar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for b in batches:
            clauses = [grammar.matched(t) for t in b.column(1).to_pylist()]
            z = np.clip(grammar.a + grammar.b * squash(np.array([sum(w for *_, w in c) for c in clauses], float)), -30, 30)
            s = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([len(c) for c in clauses], pa.int64())], ["id", "score", "predicted", "n_clauses"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, n_clauses bigint")
    return out.withColumnRenamed("id", id_col)
