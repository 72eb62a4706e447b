"""Operators 4 and 9: memory follows neither the number of lines in a batch, nor their length, nor the pairs of a block."""

import tracemalloc

import numpy as np
import pyarrow as pa

from heddle.llm import blocks, lines


def brute(sets, left, right, percent):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (left[i] and right[j] or left[j] and right[i]) and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def test_links_of_a_block_in_bounded_memory():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, 30, np.uint64)) for _ in range(3000)]
    block = np.arange(3000) % 2
    tracemalloc.start()
    assert list(blocks.links([b"%d" % i for i in range(3000)], sets, block == 0, block == 1, 80)) == []
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()


def test_links_are_those_of_all_pairs():
    r = np.random.default_rng(2)
    base = [r.integers(0, 2**63, 40, np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[i % 6][: r.integers(30, 41)], r.integers(0, 2**63, 3, np.uint64)])) for i in range(90)]
    for left, right in ((np.arange(90) < 40, np.arange(90) >= 40), (np.ones(90, bool), np.ones(90, bool))):
        forest = blocks.Forest(90)
        for a, b in blocks.links([b"%02d" % i for i in range(90)], sets, left, right, 80):
            assert a < b and forest.join(int(a), int(b))
        want = brute(sets, left, right, 80)
        assert all((forest.root(i) == forest.root(j)) == (want[i] == want[j]) for i in range(90) for j in range(i))


def test_batches_are_hashed_in_pieces():
    texts = ["é" * 3000 + str(i) for i in range(1000)] + ["", "x" * 3_000_000, "y", "z"]
    parts = list(lines.pieces(pa.RecordBatch.from_arrays([pa.array(range(1004)), pa.array(texts)], ["id", "norm"]), 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(sum(len(x.encode()) for x in p.column(1).to_pylist()[1:]) < lines.PIECE for p in parts)
