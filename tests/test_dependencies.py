"""Propagation to the end, cycles of any length, closures and mechanisms against plain versions."""

from collections import deque

import numpy as np
import pytest

from heddle.operators import dependencies as D
from heddle.operators.fixpoint import grow, on_cycles

EDGE = "child string, parent string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_propagate(changed, edges, total, most=2):
    consumers = {}
    for a, b in edges:
        consumers.setdefault(a, set()).add(b)
    queue, paths, full = deque((x, [x]) for x in sorted(changed)), {}, False
    while queue:
        at, path = queue.popleft()
        if at in paths:
            continue
        paths[at] = path
        open_ = sorted(consumers.get(at, set()) - set(paths))
        full |= (len(path) > most and bool(open_)) or len(paths) > min(500, max(1, total * 0.3))
        queue.extend((x, [*path, x]) for x in open_)
    return sorted((x, len(p) - 1, ">".join(p), "full_revalidation" if full else "dependency_revalidation") for x, p in paths.items())


CASES = {
    "diamond and cycle": ({"a", "b"}, [("a", "p"), ("b", "p"), ("p", "q"), ("a", "q"), ("q", "a"), ("q", "r"), ("r", "s"), ("s", "t")], 1000),
    "open consumer of the same level": ({"0"}, [("0", "1"), ("1", "2"), ("1", "3"), ("2", "3")], 1000),
    "consumer met before": ({"0"}, [("0", "1"), ("1", "2"), ("1", "3"), ("3", "2")], 1000),
    "cycle": ({"a"}, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], 4),
    "self loop at the edge": ({"a"}, [("a", "b"), ("b", "c"), ("c", "c")], 1000),
    "short": ({"a", "b"}, [("a", "p"), ("b", "p"), ("p", "q"), ("a", "q"), ("q", "a"), ("q", "r")], 1000),
    "many": ({"a"}, [("a", "b"), ("a", "c")], 9),
    "nothing changed": (set(), [("a", "b")], 9),
}


@pytest.mark.parametrize("case", CASES)
def test_propagation(spark, case):
    changed, edges, total = CASES[case]
    got = D.propagate(spark.createDataFrame([(x,) for x in changed], "id string"), spark.createDataFrame(edges, EDGE), total)
    assert rows(got) == plain_propagate(changed, edges, total)


def test_propagation_on_a_random_graph(spark):
    rng = np.random.default_rng(1)
    edges = [(f"{a}", f"{b}") for a, b in rng.integers(0, 150, (220, 2))]
    got = D.propagate(spark.createDataFrame([("3",), ("77",)], "id string"), spark.createDataFrame(edges, EDGE), 2_000)
    assert rows(got) == plain_propagate({"3", "77"}, edges, 2_000)


def test_long_chain_keeps_plans_small(spark):
    """Fifty rounds; the last round's plan is no larger than the third's."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "at int, id int")
    sizes = []

    def step(delta):
        out = delta.withColumnRenamed("id", "at").join(chain, "at").select("id")
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
        return out

    got = grow(spark.createDataFrame([(0,)], "id int"), step, ["id"])
    assert rows(got) == [(i, i) for i in range(51)]
    assert max(sizes[3:]) <= sizes[3] + 60


def plain_cycles(pointers):
    out = []
    for start in pointers:
        at, seen = pointers[start], [start]
        while at in pointers and at not in seen:
            seen.append(at)
            at = pointers[at]
        if at == start:
            out.append((start, len(seen)))
    return sorted(out)


@pytest.mark.parametrize("case", ["ring", "rho", "tree", "self", "empty", "random"])
def test_cycles(spark, case):
    rng = np.random.default_rng(5)
    pointers = {
        "ring": {i: (i + 1) % 9 for i in range(9)}, "rho": {**{i: i + 1 for i in range(37)}, 37: 20}, "tree": {i: i // 2 for i in range(2, 40)},
        "self": {1: 1, 2: 1, 3: 4, 4: 3}, "empty": {}, "random": {int(i): int(rng.integers(0, 220)) for i in rng.permutation(260)[:200]}}[case]
    got = on_cycles(spark.createDataFrame(list(pointers.items()), "src int, dst int"))
    assert rows(got) == plain_cycles(pointers)


def test_closure_keeps_the_best_reason(spark):
    nodes = spark.createDataFrame([(i, n, i != 7) for i, n in enumerate(["a", "b", "c", "d", "e", "T", "U", "v"])], "id int, name string, is_function boolean")
    edges = spark.createDataFrame([(0, 1, "calls"), (1, 0, "calls"), (1, 2, "calls"), (2, 3, "calls"), (4, 3, "calls"), (0, 5, "type_use"), (2, 6, "global_ref"), (7, 6, "type_use"), (0, 4, "includes")], "src int, dst int, kind string")
    owners = spark.createDataFrame([("x", 0, 2), ("y", 0, 0), ("z", 7, 1)], "owner string, node int, call_depth int")
    named = spark.createDataFrame([("x", "b", False), ("x", "a", True), ("y", "e", True), ("y", "M", False), ("y", "gone", True), ("y", "also gone", False), ("z", "M", True), ("w", "a", True)], "owner string, name string, declared boolean")
    identifiers = spark.createDataFrame([(0, "M"), (0, "noise"), (7, "N")], "id int, name string")
    prints = spark.createDataFrame([("0", "p0"), ("macro:M", "pm"), ("facts:0", "f0"), ("build_config", "cfg")], "dependency_id string, fingerprint string")
    got = D.closure(owners, named, nodes, edges, identifiers, spark.createDataFrame([("M",), ("N",)], "name string"), prints)
    kinds = {(o, i): k for o, i, k, _ in rows(got.na.fill("null"))}
    assert len(kinds) == got.count()
    # b is mentioned, so it is there before calls are followed and is not expanded: c stays out.
    assert {i: k for (o, i), k in kinds.items() if o == "x" and ":" not in i} == {"0": "anchor", "1": "mentioned_entity", "5": "referenced_entity", "build_config": "config"}
    assert {i: k for (o, i), k in kinds.items() if o == "y"} == {
        "0": "anchor", "4": "declared_entity", "5": "referenced_entity", "facts:0": "semantic_skeleton", "facts:4": "semantic_skeleton", "macro:M": "macro_definition", "build_config": "config", "gone": "missing"}
    assert {i: k for (o, i), k in kinds.items() if o == "z"} == {"7": "anchor", "macro:M": "declared_macro", "build_config": "config"}
    assert {f for o, i, _, f in rows(got.na.fill("null")) if i in ("0", "4", "gone")} == {"p0", "unknown", "null"}
    two = D.closure(owners.where("owner = 'x'"), named.where("false"), nodes, edges, identifiers, spark.createDataFrame([], "name string"), prints)
    assert {i: k for _, i, k, _ in rows(two) if ":" not in i} == {"0": "anchor", "1": "call_dependency", "2": "call_dependency", "5": "referenced_entity", "6": "referenced_entity", "build_config": "config"}


def plain_mechanism(entry, out, most=6):
    queue, members, truncated = deque([(entry, 0)]), [], False
    while queue:
        at, level = queue.popleft()
        if at in members:
            continue
        if len(members) >= most:
            truncated = True
            break
        members.append(at)
        for x in out.get(at, []):
            if level < 2 and x not in members:
                queue.append((x, level + 1))
            elif level >= 2:
                truncated = True
    return members, truncated


@pytest.mark.parametrize("degree", [1, 3, 9])
def test_mechanisms(spark, degree):
    rng = np.random.default_rng(degree)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (60 * degree, 2))})
    order = {i: (int(rng.integers(0, 5)), i) for i in range(60)}
    nodes = spark.createDataFrame([(i, order[i][0]) for i in range(60)], "id int, path int")
    got = {r["entry"]: (r["members"], r["truncated"]) for r in D.mechanisms(nodes, spark.createDataFrame(edges, "src int, dst int"), ["path"]).collect()}
    out = {a: sorted((b for x, b in edges if x == a), key=order.get) for a in range(60)}
    assert got == {i: plain_mechanism(i, out) for i in range(60)}
