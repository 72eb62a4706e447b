"""Operator 7: the composed grammar against plain rules, and its reach over whole clauses."""

import itertools
import random

import pytest

from heddle.llm import toxicity as X

MODEL = X.Model(weights={"idiot": 3.0, "scum*": 2.0, "kill you": 4.0, "kill": 1.0})
VOCABULARY = ["idiot", "scummy", "kill", "you", "not", "said", "and", "they", "the"]


def outcomes(words):
    """Every reading of the words (a hit of the phrase or of the word) by the rules, without transducers."""
    places = []
    for i, w in enumerate(words):
        own = [3.0] if w == "idiot" else [2.0] if w.startswith("scum") else [1.0] if w == "kill" else []
        if w == "kill" and words[i + 1 : i + 2] == ["you"]:
            own.append(4.0)
        if own:
            places.append((i, own))
    said = next((i for i, w in enumerate(words) if w in X.REPORTS), len(words))
    for chosen in itertools.product(*(own for _, own in places)):
        total = 0.0
        for (i, _), v in zip(places, chosen):
            v *= X.REPORTED if i > said else 1.0
            v *= X.NEGATED if any(w in X.NEGATIONS for w in words[max(0, i - X.NEG_SPAN) : i]) else 1.0
            v *= X.AIMED if any(w in X.TARGETS for w in words[max(0, i - X.TARGET_SPAN) : i + X.TARGET_SPAN + 1]) else 1.0
            total += v
        yield total


def test_best_path_equals_the_rules():
    grammar, r = X.Grammar(MODEL), random.Random(3)
    for _ in range(400):
        words = r.choices(VOCABULARY, k=r.randint(1, 14))
        assert grammar.clause(words) == pytest.approx(max(outcomes(words))), words


def paths(t, symbols):
    """All (written symbols, product of weights) of accepting paths."""
    now = [(t.start, (), 1.0)]
    for x in symbols:
        now = [(to, (*out, y), w * v) for s, out, w in now for to, y, v in t.arcs.get((s, x), ())]
    return [(out, w) for s, out, w in now if s in t.finals]


def test_composition_equals_running_one_after_the_other():
    one, two, three = X.negation(), X.reported(), X.aimed()
    for symbols in itertools.product(X.SYMBOLS, repeat=5):
        apart = [(c, u * v * w) for a, u in paths(one, symbols) for b, v in paths(two, a) for c, w in paths(three, b)]
        assert sorted((o, round(w, 9)) for o, w in paths(X.CONTEXT, symbols)) == sorted((o, round(w, 9)) for o, w in apart)


def test_reporting_verb_far_before_the_insult():
    grammar = X.Grammar(MODEL)
    near, far = "he said idiot", "he said " + "word " * 1000 + "idiot"
    assert grammar.raw(near) < grammar.raw("he is an idiot")
    assert grammar.raw(far) == pytest.approx(X.REPORTED * 3.0)
    assert grammar.raw("he said so. " + "word " * 1000 + "idiot") == pytest.approx(3.0)


def test_curly_apostrophe_negates():
    grammar = X.Grammar(MODEL)
    assert grammar.raw("it aren’t idiot") == grammar.raw("it aren't idiot") < grammar.raw("it is idiot")
