"""Operators 6 and 10 against plain versions without arrays, postings or packed keys."""

import math
import random
import re
from collections import Counter

import pytest

from heddle.llm import langid, licenses


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return []
    s = f" {' '.join(words)} "
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]


def packed(gram):
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def plain_profile(text, top):
    counts = Counter(plain_grams(text))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:top]


def plain_judgement(text, profiles, top):
    own = plain_profile(text, top)
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(own)) for lang, p in profiles.items()}
    order = sorted(far, key=lambda lang: (far[lang], lang))
    first, second = far[order[0]], far[order[1]]
    return order[0], second / (first + second) if first + second else 0.5


def test_out_of_place_distance():
    r = random.Random(4)
    alphabets = {"a": "etaoin shrdlu", "b": "äöüß enrst", "c": "数据库分析 的是"}
    make = lambda k, n: "".join(r.choices(alphabets[k], k=n))
    top = 60
    profiles = {k: plain_profile(make(k, 3000), top) for k in alphabets}
    judge = langid.Judge({k: [packed(g) for g in p] for k, p in profiles.items()}, top)
    for text in [*(make(k, n) for k in alphabets for n in (1, 5, 40, 900)), make("a", 30) + make("b", 40), "12 34", "", None, "___", "x"]:
        lang, score = judge(text)
        want = plain_judgement(text, profiles, top)
        assert lang == want[0] and score == pytest.approx(want[1])


def plain_labels(text, n, df, templates):
    w = licenses.words(text)
    idf = lambda x: math.log((n + 1) / (df.get(x, 0) + 0.5))
    best = {}
    for label, body, key in ((a, b.encode().split(), c.encode().split()) for a, b, c in templates):
        anchors = {*sorted(set(body), key=lambda x: (-idf(x), x))[: licenses.ANCHORS], *key}
        at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
        for start in range(-len(body), len(w)):
            agreeing = {x for i, x in enumerate(body) if x in anchors and 0 <= start + i < len(w) and w[start + i] == x}
            stands = any(w[k : k + len(key)] == key for k in range(max(0, start + at - licenses.SLACK), start + at + licenses.SLACK + 1))
            if len(agreeing) < min(2, len(set(key))) or not stands:
                continue
            found, k = 0, max(0, start)
            for x in body:
                near = w[k : k + licenses.SLACK + 1]
                if x in near:
                    found, k = found + 1, k + near.index(x) + 1
            if found / len(body) >= licenses.COVERED:
                best[label] = max(best.get(label, 0), found / len(body))
    base = {b for p, b in licenses.BASE.items() if any(w[i : i + len(p.split())] == p.encode().split() for i in range(len(w)))}
    return ",".join(sorted(base | set(best))), min(1.0, max([*best.values(), 0.6 if base else 0.0]))


def test_labels_and_scores():
    r = random.Random(8)
    filler = "the of and data code file project uses under license version permission free software".split()
    df = {x.encode(): k for k, x in enumerate(filler, 3)}
    index = licenses.Index(50, df)
    for _ in range(150):
        words = r.choices(filler, k=r.randint(0, 30))
        for _ in range(r.choice([0, 1, 1, 2])):
            body = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, len(body) // 4, len(body) // 2])):
                body[r.randrange(len(body))] = r.choice(filler)
            at = r.randint(0, len(words))
            words[at:at] = body
        got = index.scan(" ".join(words))
        labels, score = plain_labels(" ".join(words), 50, df, licenses.TEMPLATES)
        assert got[-2] == labels and got[-1] == pytest.approx(score)
