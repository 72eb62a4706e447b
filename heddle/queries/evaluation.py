"""Evaluation queries: retrieval quality, percentiles, effects, agreement, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import evaluation as E
from heddle.operators import ranking as K
from heddle.operators import retrieval as R
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

RANKED = (
    "part AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)",
    "mean AS (SELECT label AS qid, k, avg(x) AS m FROM part GROUP BY 1, 2)",
    "lane AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT m.qid, p.vec_id AS id, round(sum(p.x * m.m), 6) AS score FROM part p JOIN mean m ON m.k = p.k GROUP BY 1, 2) QUALIFY rank <= 30)",
    "gold AS (SELECT label AS qid, vec_id AS id FROM embeddings)",
    "quality AS (SELECT w.qid, round(coalesce(hits, 0) / least(n_gold, 10), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1) w LEFT JOIN (SELECT l.qid, count(*) AS hits, min(l.rank) AS first FROM lane l JOIN gold g ON g.qid = l.qid AND g.id = l.id WHERE l.rank <= 10 GROUP BY 1) h ON h.qid = w.qid)",
)


def quality(s, d):
    vectors = table(s, d, "embeddings")
    lane = R.vector_lane(vectors, R.centroids(vectors).select(F.col("label").alias("qid"), F.col("mean").alias("v")))
    return E.recall_mrr(lane.select("qid", F.col("vec_id").alias("id"), "rank"), vectors.select(F.col("label").alias("qid"), F.col("vec_id").alias("id")))


@query("recall_mrr", oracle("SELECT qid, recall, mrr FROM quality", *RANKED))
def recall_mrr(s, d):
    return quality(s, d)


@query("recall_by_type", oracle("SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n FROM quality", *RANKED))
def recall_by_type(s, d):
    return quality(s, d).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n"))


@query("retrieval_percentiles", oracle("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"))
def retrieval_percentiles(s, d):
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(x * 100)}")
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5), p(0.95))


@query("p95_variants", oracle(
    "SELECT event_type, v[greatest(1, ceil(0.95 * len(v)))::BIGINT] AS nearest, v[(ceil((len(v) - 1) * 0.95) + 1)::BIGINT] AS linear FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)"))
def p95_variants(s, d):
    """The value at position ceil(0.95 n), and the one that linear interpolation ends at, both by rank: no list of values is built."""
    rows = K.numbered(table(s, d, "events").where("value is not null").select("event_type", "value"), ["value"], ["event_type"])
    n = rows.groupBy("event_type").agg(F.max("rank").alias("n"))
    nearest = F.greatest(F.lit(1), F.ceil(F.lit(0.95) * F.col("n")))
    linear = F.ceil((F.col("n") - 1) * F.lit(0.95)) + 1
    at = lambda place: F.max(F.when(F.col("rank") == place, F.col("value")))
    return rows.join(F.broadcast(n), "event_type").groupBy("event_type").agg(at(nearest).alias("nearest"), at(linear).alias("linear"))  # n: a row a type of event


SETS = ("predicted AS (SELECT DISTINCT user_id AS k, event_type AS item FROM events WHERE value >= 50)", "gold AS (SELECT DISTINCT user_id AS k, event_type AS item FROM events WHERE value < 80)")


@query("set_prf1", oracle(
    "SELECT k, round(CASE WHEN np > 0 THEN c / np ELSE 0 END, 6) AS precision, round(CASE WHEN ng > 0 THEN c / ng ELSE 0 END, 6) AS recall, round(CASE WHEN np + ng > 0 THEN 2 * c / (np + ng) ELSE 0 END, 6) AS f1 FROM (SELECT coalesce(p.k, g.k) AS k, count(p.k) AS np, count(g.k) AS ng, count(CASE WHEN p.k IS NOT NULL AND g.k IS NOT NULL THEN 1 END) AS c FROM predicted p FULL JOIN gold g ON p.k = g.k AND p.item = g.item GROUP BY 1)", *SETS))
def set_prf1(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("item"), "value")
    return E.set_scores(rows.where("value >= 50").select("k", "item").distinct(), rows.where("value < 80").select("k", "item").distinct(), "k", "item")


@query("refusal_accuracy", oracle("SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT q.qid, count(b.rowid) > 0 AS hit FROM question q LEFT JOIN bm25 b ON b.qid = q.qid GROUP BY 1)"))
def refusal_accuracy(s, d):
    """The share of questions with a lexical hit, which are those that must not be refused."""
    q = facts.question(s, d)
    wanted = R.query_terms(q)
    hit = R.bm25(R.bm25_scores(facts.matched(s, d, wanted), facts.corpus(facts.meta(s, d)), wanted)).select("qid").distinct().withColumn("hit", F.lit(1))
    return q.select("qid").join(hit, "qid", "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("accuracy"))


@query("maintenance_confusion", oracle(
    "SELECT policy, sum(CASE WHEN p = expected THEN 1 ELSE 0 END)::BIGINT AS correct, sum(CASE WHEN expected = 1 AND p = 0 THEN 1 ELSE 0 END)::BIGINT AS missed, sum(CASE WHEN expected = 0 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS false_alarm, round(sum(CASE WHEN expected = 1 AND p = 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN expected = 1 THEN 1 ELSE 0 END), 0), 6) AS missed_rate, round(sum(CASE WHEN expected = 0 AND p = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN expected = 0 THEN 1 ELSE 0 END), 0), 6) AS false_rate FROM (SELECT 'all' AS policy, toxic AS expected, 1 AS p FROM labels UNION ALL SELECT 'none', toxic, 0 FROM labels UNION ALL SELECT 'quality', toxic, 1 - quality FROM labels) GROUP BY 1"))
def maintenance_confusion(s, d):
    """Three policies that predict `toxic`: always, never, and by low quality."""
    policies = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), v.cast("int").alias("predicted")) for n, v in (("all", F.lit(1)), ("none", F.lit(0)), ("quality", 1 - F.col("quality"))))))
    return E.confusion(table(s, d, "labels").select(F.col("toxic").alias("expected"), policies.alias("p")).select("expected", "p.*"), "policy")


@query("review_metrics", oracle("SELECT arm, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, CASE WHEN count(value) = count(*) THEN round(sum(value), 2) END AS total FROM trial GROUP BY 1"))
def review_metrics(s, d):
    return facts.trial(s, d).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(E.null_strict_sum("value"), 2).alias("total"))


PAIRED = "paired AS (SELECT repository, mechanism, task, max(CASE arm WHEN 'F' THEN m END) - max(CASE arm WHEN 'O' THEN m END) AS delta FROM (SELECT repository, mechanism, task, arm, avg(value) AS m FROM trial GROUP BY ALL) GROUP BY ALL HAVING delta IS NOT NULL)"
UNITS = ["repository", "mechanism", "task"]


@query("paired_effect", oracle("SELECT count(*) AS n, round(avg(delta), 4) AS effect FROM paired", PAIRED))
def paired_effect(s, d):
    return E.paired(facts.trial(s, d), UNITS, "F", "O").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("effect"))


@query("grouped_effect", oracle("SELECT count(*) AS n, round(avg(e), 4) AS effect FROM (SELECT mechanism, avg(delta) AS e FROM paired GROUP BY 1)", PAIRED))
def grouped_effect(s, d):
    by = E.paired(facts.trial(s, d), UNITS, "F", "O").groupBy("mechanism").agg(F.avg("delta").alias("e"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("effect"))


@query("repo_equal_effect", oracle("SELECT count(*) AS n, round(avg(e), 4) AS effect FROM (SELECT repository, avg(e) AS e FROM (SELECT repository, mechanism, avg(delta) AS e FROM paired GROUP BY 1, 2) GROUP BY 1)", PAIRED))
def repo_equal_effect(s, d):
    by = E.paired(facts.trial(s, d), UNITS, "F", "O").groupBy("repository", "mechanism").agg(F.avg("delta").alias("e"))
    return by.groupBy("repository").agg(F.avg("e").alias("e")).agg(F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("effect"))


@query("bootstrap_ci")
def bootstrap_ci(s, d):
    """95 % interval of the mechanisms' mean effect."""
    by = E.paired(facts.trial(s, d), UNITS, "F", "O").groupBy("repository", "mechanism").agg(F.avg("delta").alias("delta"))
    return E.bootstrap(by.select(F.concat_ws("/", "repository", "mechanism").alias("unit"), "delta"))


@query("reviewer_agreement", oracle("SELECT count(*) AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END)::BIGINT AS agree, round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 6) AS rate FROM labels"))
def reviewer_agreement(s, d):
    same = (F.col("quality") == F.col("toxic")).cast("int")
    return table(s, d, "labels").agg(F.count("*").alias("n"), F.sum(same).alias("agree"), F.round(F.avg(same), 6).alias("rate"))


@query("point_verdict", oracle("SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'complete' ELSE 'partial' END AS verdict FROM labels"))
def point_verdict(s, d):
    return table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "complete").otherwise("partial").alias("verdict"))


@query("null_strict_usage", oracle("SELECT user_id, count(*) AS n, CASE WHEN count(nullif(event_type, 'error')) = count(*) THEN round(sum(value), 4) END AS usage FROM events GROUP BY 1"))
def null_strict_usage(s, d):
    """A run's usage, unknown where any of its calls failed."""
    rows = table(s, d, "events").withColumn("known", F.when(F.col("event_type") != "error", F.col("value")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(E.null_strict_sum("known"), 4).alias("usage"))


@query("round_robin_sample", oracle("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents"))
def round_robin_sample(s, d):
    return K.round_robin(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("balanced_sample", oracle("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(doc_id::VARCHAR), doc_id) AS turn FROM documents) WHERE turn <= 20"))
def balanced_sample(s, d):
    """Twenty documents of each language in a fixed random order."""
    return K.top(table(s, d, "documents").select("doc_id", "lang"), "lang", [F.sha1(F.col("doc_id").cast("string").cast("binary")), "doc_id"], 20, "turn")


@query("interleave", oracle("SELECT arm, task, value, (row_number() OVER (PARTITION BY arm ORDER BY task, value) - 1) // 3 AS block FROM trial"))
def interleave(s, d):
    """Trials dealt to blocks of three of each arm."""
    rows = K.round_robin(facts.trial(s, d).select("arm", "task", "value"), "arm", ["task", "value"])
    return rows.select("arm", "task", "value", F.floor((F.col("turn") - 1) / 3).alias("block"))


@query("outcome_breakdown", oracle("SELECT o_orderpriority AS reason, o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1, 2"))
def outcome_breakdown(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("reason"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))


@query("ablation_pivot", oracle("SELECT mechanism, round(avg(value) FILTER (arm = 'F'), 4) AS f, round(avg(value) FILTER (arm = 'O'), 4) AS o, round(avg(value) FILTER (arm = 'P'), 4) AS p FROM trial GROUP BY 1"))
def ablation_pivot(s, d):
    wide = facts.trial(s, d).groupBy("mechanism").pivot("arm", ["F", "O", "P"]).agg(F.avg("value"))
    return wide.select("mechanism", *(F.round(c, 4).alias(c.lower()) for c in ("F", "O", "P")))
