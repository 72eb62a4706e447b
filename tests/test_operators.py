"""Operators on small hand-made tables: invariants that hold whatever the input."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import evaluation as E
from heddle.operators import governance as V
from heddle.operators import graph as G
from heddle.operators import incremental as I
from heddle.operators import ranking as K
from heddle.functions.text import terms
from heddle.operators import contracts as C
from heddle.operators import retrieval as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_confirmed_edges_are_walked(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(G.neighbors(edges, 2, seeds)) == [("a", "a", 2), ("a", "b", 1), ("a", "c", 1)]
    assert rows(G.neighbors(edges, 1, seeds, reverse=True)) == [("a", "c", 1)]
    assert rows(G.neighbors(edges.limit(0), 2)) == []


def test_retraction_equals_rebuild(spark):
    obs = spark.createDataFrame([("t1", "x", "y", "certain"), ("t2", "x", "y", "certain"), ("t1", "y", "z", "candidate")], "tu string, src string, dst string, confidence string")
    gone = spark.createDataFrame([("t1",)], "tu string")
    assert rows(I.retract(obs, gone)) == [("x", "y", "certain", 1)]
    assert rows(I.retract(obs, gone)) == rows(G.dedup_edges(obs.where("tu <> 't1'")))
    assert rows(I.retract(obs, obs)) == []
    assert rows(G.dedup_edges(I.refresh(obs, obs.where("tu = 't1'")))) == rows(G.dedup_edges(obs))


def test_rank_fusion(spark):
    lane = lambda ids: spark.createDataFrame([(1, x, k) for k, x in enumerate(ids, 1)], "qid int, rowid int, rank int")
    got = {r.rowid: (r.score, r.rank) for r in R.fuse([(lane([1, 2, 3]), 1.0), (lane([3, 2, 1]), 1.0)]).collect()}
    assert got[2][0] == round(2 / 62, 6) and got[1][0] == got[3][0] == round(1 / 61 + 1 / 63, 6)
    assert (got[1][1], got[3][1], got[2][1]) == (1, 2, 3)


def test_budgets(spark):
    heads = spark.createDataFrame([(1, k, c, k) for k, c in enumerate((100, 70, 50, 10))], "q int, rank int, cost int, item bigint")
    assert [r.cost for r in K.prefix_within(heads, "q", ["rank"], "cost", 165).orderBy("rank").collect()] == [100]
    assert rows(K.first_fit(heads, "q", "rank", "cost", "item", 165)) == [(1, 0), (1, 2), (1, 3)]


def test_unknown_is_not_zero(spark):
    usage = spark.createDataFrame([(1, 5), (1, None), (2, 3)], "k int, v int")
    assert rows(usage.groupBy("k").agg(E.null_strict_sum("v"))) == [(1, None), (2, 3)]


def test_nearest_rank(spark):
    v = spark.range(1, 5).agg(F.collect_list("id").alias("v"))
    assert v.select(E.nearest_rank(F.array_sort("v"), 0.5)).first()[0] == 2


def test_equal_weight_differs_from_pooled(spark):
    trials = [("r1", "m", t, a, v) for t in range(3) for a, v in (("F", 3.0), ("O", 1.0))] + [("r2", "m", 9, "F", 10.0), ("r2", "m", 9, "O", 0.0)]
    df = spark.createDataFrame(trials, "repository string, mechanism string, task int, arm string, value double")
    delta = E.paired(df, ["repository", "mechanism", "task"], "F", "O")
    assert delta.agg(F.avg("delta")).first()[0] == 4.0
    assert delta.groupBy("repository").agg(F.avg("delta").alias("e")).agg(F.avg("e")).first()[0] == 6.0


def test_bootstrap_interval(spark):
    deltas = spark.range(200).select(F.col("id").cast("string").alias("unit"), (F.col("id") % 10).cast("double").alias("delta"))
    r = E.bootstrap(deltas, resamples=300).first()
    assert r.low < 4.5 < r.high and 0.3 < r.high - r.low < 1.5 and abs(r.mean - 4.5) < 0.1


def test_hidden_rows_do_not_fill_the_top(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [0.9, 0.1], True), (3, [0.0, 1.0], True)], "vec_id int, embedding array<double>, visible boolean")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid int, v array<double>")
    assert [r.vec_id for r in R.vector_lane(v.where("visible"), q, 1).collect()] == [2]


def test_nonsense_is_refused(spark):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "zzzz")], "qid int, text string")
    matched = spark.createDataFrame([(5, "alpha", 1, 4)], "rowid int, term string, tf bigint, dl int")
    corpus = spark.createDataFrame([(2, 3.0)], "n_docs bigint, avgdl double")
    found = R.bm25(R.bm25_scores(matched, corpus, R.query_terms(asked))).withColumn("level", F.lit("A"))
    assert [(r.qid, r.refused) for r in R.decide(asked, found).orderBy("qid").collect()] == [(1, False), (2, True)]


def test_terms_of_any_script(spark):
    df = spark.createDataFrame([("Naïve Straße 数据库 a_1!",)], "t string")
    assert df.select(terms("t").alias("x")).first().x == ["naïve", "straße", "数据库", "a_1"]


def test_symbol_tiers(spark):
    symbols = spark.createDataFrame([(1, "get_user_name", "core"), (2, "get_user_id", "core"), (3, "set_flag", "util"), (4, "user_name_get_all", "x"), (5, "other_thing_here", "y")], "rowid int, name string, file string")
    names = spark.createDataFrame([(1, "get_user_name", "get_user_")], "qid int, full_name string, start string")
    query = spark.createDataFrame([(1, t) for t in ("get", "user", "name", "util")], "qid int, term string")
    got = [(r.rowid, r.tier, r.rank) for r in R.symbol_lane(symbols, names, query, ("get",)).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4)]


def test_expansion_goes_both_ways_and_keeps_the_best(spark):
    fused = spark.createDataFrame([(1, 10, 1.0, 1), (1, 20, 0.5, 2)], "qid int, rowid int, score double, rank bigint")
    edges = spark.createDataFrame([(10, 30), (40, 10), (30, 50), (20, 30)], "src int, dst int")
    got = sorted((r.rowid, r.hop, r.score) for r in R.expand(fused, edges).collect())
    assert got == [(30, 1, 0.75), (40, 1, 0.75), (50, 2, 0.5625)]


def test_reserved_slots(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 16)], "qid int, rowid int, rank bigint")
    order = lambda wanted: [r.rowid for r in R.reserve(ranked, spark.createDataFrame([(1, i, t) for t, i in enumerate(wanted, 1)], "qid int, rowid int, turn int"), 10).orderBy("rank").collect()]
    plain = list(range(1, 16))
    assert order([3]) == plain
    assert order([12]) == [*range(1, 10), 12, 10, 11, 13, 14, 15]
    assert order([12, 14]) == [*range(1, 9), 12, 9, 14, 10, 11, 13, 15]
    assert order([10, 14]) == [*range(1, 9), 10, 9, 14, 11, 12, 13, 15]


def test_session_gate(spark):
    said = [(1, "user", "what does parse_item( do"), (1, "developer", "check it"), (2, "user", "Password: x"), (2, "system", "y")]
    heads = [(1, "public_synthetic", "MIT", "abcdef1"), (2, "private", None, "unversioned"), (3, "public_synthetic", "MIT", "abcdef1")]
    got = V.session_gate(spark.createDataFrame(heads, "session int, source_type string, license string, revision string"), spark.createDataFrame(said, "session int, role string, text string"))
    assert {r.session: r.failed for r in got.collect()} == {
        1: "", 2: "public_source,public_license,fixed_revision,reproducible_input,verification_signal,message_structure,sensitive_scan",
        3: "reproducible_input,verification_signal,message_structure,sensitive_scan"}


def test_snapshot_plan_and_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "k string, v string")
    assert rows(I.changes(old, new, "k", "v")) == [("a", "1", None), ("b", "2", "3"), ("d", None, "4")]
    plan = I.plan(I.fingerprints(old, "k", ["v"]), I.fingerprints(new, "k", ["v"]), "k")
    assert rows(plan) == [("a", "removed"), ("b", "changed"), ("c", "reuse"), ("d", "new")]


@pytest.mark.parametrize("swap", [False, True])
def test_fingerprint_ignores_row_order(spark, swap):
    data = [("a", "1"), ("a", "2"), ("b", "1")]
    df = spark.createDataFrame(data[::-1] if swap else data, "k string, v string").repartition(3)
    assert len({r.fingerprint for r in I.fingerprints(df, "k", ["v"]).collect()}) == 2


@pytest.mark.parametrize("key", [None, ["k"]])
def test_numbered_over_many_ranges(spark, key):
    from pyspark.sql import functions as F

    from heddle.operators import ranking as K

    data = [(None if i % 11 == 0 else i % 3, (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(data, "k int, v int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = K.numbered(df, [F.desc("v"), "i"], key).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for k, v, i in data:
        groups.setdefault(k if key else 0, []).append((-v, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert {r.i: r["rank"] for r in got} == want and len(got) == 400


def test_citations_match_anchors_and_facts(spark):
    from heddle.operators import citations as C

    cites = spark.createDataFrame([(1, "f", "a.c", 3), (1, "f", "b.c", 9)], "task int, symbol string, path string, line_start int")
    anchors = spark.createDataFrame([(1, 1, "f", "a.c", None), (1, 2, "f", "b.c", 9), (1, 3, "f", "b.c", 8), (2, 1, "f", "a.c", None)], "task int, anchor int, symbol string, path string, line_start int")
    assert {(r.task, r.anchor): r.matched for r in C.matches(cites, anchors).collect()} == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False}
    claims = spark.createDataFrame([("x", "f1", "p"), ("x", "f2", "q"), ("y", "f1", "other"), ("z", "gone", "p"), ("w", "f1", None)], "answer string, fact string, payload string")
    known = spark.createDataFrame([("f1", "p"), ("f2", "q")], "fact string, payload string")
    assert {r.answer: r.valid for r in C.selected_facts(claims, known).collect()} == {"x": True, "y": False, "z": False, "w": False}


def test_question_parts(spark):
    from heddle.functions import queries as Q

    row = spark.createDataFrame([("谁调用 parsed_HTTPValues 和 x",)], "t string").select(Q.enriched("t").alias("e"), Q.query_parts("t").alias("p"), Q.expansion("t").alias("x")).first()
    assert row.e == "谁调用 parsed_HTTPValues 和 x call caller"
    assert row.p == ["httpvalues", "parse", "parsed"]  # `call` and `caller` are stop words, and only parts themselves have other forms
    assert row.x == "httpvalues parsed"
