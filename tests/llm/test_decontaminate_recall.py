"""Operator 3 finds every window within MAX_EDITS, and none beyond."""

import random

import pytest

from heddle.llm import decontaminate as D

LETTERS = "abcdefghij "


def text(r, n):
    return D.normal("".join(r.choices(LETTERS, k=2 * n)))[:n].strip().ljust(n, "x")


def edited(r, item, share, kind):
    n, e = len(item), int(share * len(item))
    places = [int((k + 0.5) * n / e) for k in range(e)] if kind == "even" else sorted(r.sample(range(n), e))
    out = list(item)
    for p in places:
        what = r.choice(["insert", "delete", "replace"]) if kind == "mixed" else "insert" if kind == "insert" else "replace"
        out[p] = {"insert": out[p] + r.choice("klm"), "delete": "", "replace": r.choice("klm")}[what]
    return "".join(out)


@pytest.mark.parametrize("kind", ["replace", "insert", "mixed", "even"])
@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.125, 0.15])
def test_recall(share, kind):
    r = random.Random(f"{share}{kind}")
    items = [(k, text(r, n)) for k, n in enumerate([10, 20, 40, 80, 100, 149, 150, 200, 300, 1000])]
    index = D.Items(items)
    texts = [f"{text(r, 3000)} {edited(r, t, share, kind) if int(share * len(t)) else t} {text(r, 700)}" for _, t in items for _ in range(6)]
    got = {(row, i) for row, i, *_ in index.matches(texts)}
    assert sum((row, row // 6) in got for row in range(len(texts))) >= 0.95 * len(texts)


def plain_distance(item, t):
    """The least edit distance of `item` to a substring of `t`, by the textbook table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_against_brute_force():
    r = random.Random(12)
    items = [(k, text(r, n)) for k, n in enumerate([30, 70, 90, 120])]
    texts = []
    for _ in range(40):
        _, t = r.choice(items)
        share = r.choice([0.05, 0.1, 0.14, 0.16, 0.2, 0.3])
        texts.append(f"{text(r, r.choice([5, 150]))} {edited(r, t, share, r.choice(['replace', 'mixed', 'insert']))} {text(r, 60)}" if r.random() < 0.8 else text(r, 200))
    got = {(row, i) for row, i, *_ in D.Items(items).matches(texts)}
    want = {(row, i) for row, t in enumerate(texts) for i, x in items if plain_distance(x, t) <= int(D.MAX_EDITS * len(x))}
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_no_window_beyond_the_edits_is_taken():
    r = random.Random(5)
    items = [(k, text(r, 300)) for k in range(5)]
    assert D.Items(items).matches([f"{text(r, 500)} {edited(r, t, 0.3, 'replace')}" for _, t in items]) == []


def test_windows_at_borders_of_chunks(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(D, "CHUNK", 2048)
    index = D.Items([(1, text(r, 120))])
    item = index.items[0][1]
    texts = [text(r, n) + edited(r, item, 0.1, "even") + text(r, 2500) for n in range(1900, 2100, 7)]
    assert len({row for row, *_ in index.matches(texts)}) >= len(texts) - 1
