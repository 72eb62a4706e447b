"""Versions of pages, copy-on-write commits, events, streams that withdraw, ranges."""

import hashlib
import os

import numpy as np
import pytest

from heddle.operators import versions as W
from heddle.operators.graph import dedup_edges
from heddle.sources import files
from heddle.streaming import events as S

PAGE = "id string, level string, input_hash string, valid boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pages(spark, **hashes):
    return spark.createDataFrame([(i, "file", h, h != "bad") for i, h in hashes.items()], PAGE)


GENERATIONS = [dict(a="1", b="1", c="1"), dict(a="1", b="2", d="bad"), dict(a="1", b="2", c="1", d="1"), dict()]


def test_merge_and_store_agree(spark, tmp_path):
    store = W.PageStore(spark, str(tmp_path / "pages"), buckets=8)
    state = spark.createDataFrame([], W.STATE)
    for n, g in enumerate(GENERATIONS):
        state = W.merge(state, pages(spark, **g), f"r{n}").drop("changed")
        store.commit(pages(spark, **g), f"r{n}")
        assert rows(store.read().drop("revision")) == rows(state.drop("revision"))
    assert rows(state.select("id", "status", "version")) == [("a", "stale", 1), ("b", "stale", 2), ("c", "stale", 2), ("d", "stale", 2)]
    assert rows(store.read(1).select("id", "status", "version")) == [("a", "ok", 1), ("b", "ok", 2), ("c", "stale", 1), ("d", "failed", 1)]


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    store = W.PageStore(spark, str(tmp_path / "pages"), buckets=16)
    first = {f"p{i}": "1" for i in range(60)}
    store.commit(pages(spark, **first), "r0")
    before = store.folders()
    assert store.commit(pages(spark, **first), "r1") == []
    touched = store.commit(pages(spark, **{**first, "p7": "2"}), "r2")
    assert len(touched) == 1 and {b for b, f in store.folders().items() if f != before[b]} == set(touched)
    assert rows(store.read().where("version = 2").select("id")) == [("p7",)]


def test_a_commit_that_died_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "pages")
    store = W.PageStore(spark, root)
    store.commit(pages(spark, a="1"), "r0")
    os.makedirs(f"{root}/commits/n=1")
    assert rows(store.read().select("id", "version")) == [("a", 1)]


def test_events_name_their_path(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "id string, hash string")
    after = spark.createDataFrame([("a", "2"), ("c", None), ("new", "1")], "id string, hash string")
    uses = spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "repo"), ("c", "other")], "child string, parent string")
    assert rows(W.invalidations(before, after, uses).select("target", "trigger", "path", "before_hash", "after_hash").na.fill("none")) == [
        ("a", "a", "a", "1", "2"), ("b", "b", "b", "1", "none"), ("m", "a", "a>m", "1", "2"), ("new", "new", "new", "none", "1"), ("repo", "a", "a>m>repo", "1", "2")]


def test_rollup_ignores_order_and_sees_every_change(spark):
    data = [("m", hashlib.sha1(bytes([i])).hexdigest()) for i in range(50)]
    hash_of = lambda x: W.rollup(spark.createDataFrame(x, "p string, hash string").repartition(3), "p").first()["hash"]
    assert hash_of(data) == hash_of(data[::-1]) != hash_of([*data[1:], data[1]])


OBSERVED = "tu bigint, src bigint, dst bigint, confidence string"


def test_stream_withdraws_what_a_unit_no_longer_shows(spark, tmp_path):
    first = [(1, 1, 2, "certain"), (1, 2, 3, "certain"), (2, 1, 2, "certain"), (3, 5, 6, "certain")]
    again = [(1, 2, 4, "certain"), (3, None, None, None), (4, 7, 8, "candidate")]
    source, edges = str(tmp_path / "in"), str(tmp_path / "edges")
    for part in (first, again):
        spark.createDataFrame(part, OBSERVED).coalesce(1).write.mode("append").parquet(source)
        S.observations_to(edges, spark.readStream.schema(OBSERVED).parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
    want = rows(dedup_edges(spark.createDataFrame([(1, 2, 4, "certain"), (2, 1, 2, "certain"), (4, 7, 8, "candidate")], OBSERVED)))
    assert rows(S.current_edges(spark, edges)) == want
    S.store_batch(edges, spark.createDataFrame(again, OBSERVED), 1)  # the same batch once more
    assert rows(S.current_edges(spark, edges)) == want


def test_pointer_survives_a_crash_and_checksum_sees_pairs(spark, tmp_path):
    root = str(tmp_path / "snap")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    assert files.checksum(one("a", "a")).first() != files.checksum(one("b", "b")).first()
    assert files.checksum(one()).first()["rows"] == 0
    for v in ("v1", "v2"):
        files.write_snapshot({"t": one(v)}, root, v)
        files.activate(spark, root, v)
    os.makedirs(f"{root}/_active/n=00000009/_temporary")  # a pointer that was never finished
    assert files.active(spark, root) == ("v2", "v1")
    assert files.rollback(spark, root) == "v1" and files.active(spark, root) == ("v1", "v2")


@pytest.mark.parametrize("seed", range(3))
def test_gaps(spark, seed):
    rng = np.random.default_rng(seed)
    draw = lambda n, w: [(int(k), int(a), int(a + s)) for k, a, s in zip(rng.integers(0, 4, n), rng.integers(-20, 60, n), rng.integers(-2, w, n))]
    need, have = draw(12, 30), draw(20, 9)
    got = W.gaps(spark.createDataFrame(need, "k int, a bigint, z bigint"), spark.createDataFrame(have, "k int, a bigint, z bigint"), "k", "a", "z")
    lines = {(k, n) for k, a, z in need for n in range(a, z + 1)} - {(k, n) for k, a, z in have for n in range(a, z + 1)}
    assert {(k, n) for k, a, z in rows(got) for n in range(a, z + 1)} == lines
    assert all((k, a - 1) not in lines and (k, z + 1) not in lines for k, a, z in rows(got))
