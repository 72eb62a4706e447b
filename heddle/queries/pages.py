"""Queries of page facts, headers, relations by kind, and approvals."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import governance as V
from heddle.operators import graph as G
from heddle.operators import pages as P
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

SEEN = (
    "site AS (SELECT l_orderkey AS tu, l_linenumber AS seq, min(l_partkey) AS p, max(l_returnflag) AS rf, max(l_linestatus) AS ls FROM lineitem GROUP BY 1, 2)",
    "after AS (SELECT *, lead(p) OVER (PARTITION BY tu ORDER BY seq) AS q FROM site)",
    "seen AS MATERIALIZED (SELECT tu, seq, p AS src, q AS dst, CASE WHEN seq <= 2 THEN 'calls' WHEN seq = 3 THEN 'type_use' WHEN seq = 4 THEN 'field_access' WHEN seq = 5 THEN 'global_ref' ELSE 'includes' END AS kind, CASE rf WHEN 'R' THEN 'candidate' ELSE 'certain' END AS confidence, concat_ws(':', ls, seq) AS reason FROM after WHERE q IS NOT NULL AND q <> p)",
    "rel AS MATERIALIZED (SELECT src, dst, kind, confidence, arg_min(reason, (tu, seq)) AS reason, count(DISTINCT tu) AS n_obs FROM seen GROUP BY 1, 2, 3, 4)",
    "whence AS MATERIALIZED (SELECT r.*, a.path AS src_path, a.name AS src_name, b.path AS dst_path, b.name AS dst_name, a.p_size AS line_start FROM rel r JOIN node a ON a.id = src JOIN node b ON b.id = dst)",
)


def relations(s, d):
    return P.placed(G.merged(facts.seen(s, d)), facts.node(s, d))


def sure(s, d):
    return relations(s, d).where("confidence = 'certain'")


@query("relation_merge", oracle("SELECT src, dst, kind, confidence, reason, n_obs FROM rel", *SEEN))
def relation_merge(s, d):
    """Relations by kind and certainty, with their first reason and the number of units."""
    return G.merged(facts.seen(s, d))


@query("orphan_purge", oracle("SELECT (SELECT count(*) FROM rel) - count(*) AS n_orphans FROM rel WHERE src IN (SELECT id FROM node WHERE p_size > 3) AND dst IN (SELECT id FROM node WHERE p_size > 3)", *SEEN))
def orphan_purge(s, d):
    """How many relations go when small parts are no nodes any more."""
    return G.purge(G.merged(facts.seen(s, d)), facts.node(s, d).where("p_size > 3"))[1]


@query("file_neighbours", oracle(
    "SELECT path, other, n, rank, side FROM (SELECT *, row_number() OVER (PARTITION BY side, path ORDER BY n DESC, other) AS rank FROM (SELECT 'out' AS side, src_path AS path, dst_path AS other, count(*) AS n FROM whence WHERE kind = 'calls' AND confidence = 'certain' AND src_path <> dst_path GROUP BY ALL UNION ALL SELECT 'in', dst_path, src_path, count(*) FROM whence WHERE kind = 'calls' AND confidence = 'certain' AND src_path <> dst_path GROUP BY ALL)) WHERE rank <= 8", *SEEN))
def file_neighbours(s, d):
    """The eight files that each file calls most, and the eight that call it most."""
    calls = sure(s, d).where("kind = 'calls'")
    return P.neighbour_files(calls).withColumn("side", F.lit("out")).unionByName(P.neighbour_files(calls, reverse=True).withColumn("side", F.lit("in")))


@query("file_flows", oracle("SELECT path, caller, callee, rank FROM (SELECT src_path AS path, src AS caller, dst AS callee, row_number() OVER (PARTITION BY src_path ORDER BY line_start, dst_name, src, dst) AS rank FROM whence WHERE kind = 'calls' AND confidence = 'certain') WHERE rank <= 40", *SEEN))
def file_flows(s, d):
    return P.flows(sure(s, d).where("kind = 'calls'"), facts.node(s, d).select(F.col("id").alias("src"), F.col("p_size").alias("line_start")))


@query("file_facts", oracle(
    "SELECT path, coalesce(o, 0) AS n_calls_out, coalesce(i, 0) AS n_calls_in, coalesce(t, 0) AS n_type_use, coalesce(f, 0) AS n_field_access, coalesce(g, 0) AS n_global_ref, coalesce(c, 0) AS n_candidates FROM (SELECT DISTINCT path FROM node)"
    " LEFT JOIN (SELECT src_path AS path, count(*) FILTER (kind = 'calls' AND src_path <> dst_path) AS o, count(*) FILTER (kind = 'type_use') AS t, count(*) FILTER (kind = 'field_access') AS f, count(*) FILTER (kind = 'global_ref') AS g FROM whence WHERE confidence = 'certain' GROUP BY 1) USING (path)"
    " LEFT JOIN (SELECT dst_path AS path, count(*) AS i FROM whence WHERE confidence = 'certain' AND kind = 'calls' AND src_path <> dst_path GROUP BY 1) USING (path) LEFT JOIN (SELECT src_path AS path, count(*) AS c FROM whence WHERE confidence = 'candidate' AND kind = 'calls' GROUP BY 1) USING (path)", *SEEN))
def file_facts(s, d):
    every = relations(s, d)
    return P.file_facts(facts.node(s, d), every.where("confidence = 'certain'"), every.where("confidence = 'candidate' and kind = 'calls'"))


BRAND = "split_part(path, '/', 1)"


@query("module_entries", oracle(
    f"SELECT module, id, fan_in, rank FROM (SELECT {BRAND} AS module, n.id, coalesce(c, 0) AS fan_in, row_number() OVER (PARTITION BY {BRAND} ORDER BY coalesce(c, 0) DESC, n.name, n.id) AS rank FROM node n LEFT JOIN (SELECT dst, count(*) AS c FROM whence WHERE kind = 'calls' AND confidence = 'certain' GROUP BY 1) ON dst = n.id WHERE is_definition) WHERE rank <= 20", *SEEN))
def module_entries(s, d):
    """The twenty most called definitions of each module (a brand)."""
    nodes = facts.node(s, d).where("is_definition").withColumn("module", F.split("path", "/")[0])
    called = sure(s, d).where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return P.module_entries(nodes, called)


@query("module_calls", oracle(
    "SELECT module, a, b, n, rank FROM (SELECT split_part(a, '/', 1) AS module, a, b, n, row_number() OVER (PARTITION BY split_part(a, '/', 1) ORDER BY n DESC, a, b) AS rank FROM (SELECT src_path AS a, dst_path AS b, count(*) AS n FROM whence WHERE kind = 'calls' AND confidence = 'certain' AND src_path <> dst_path GROUP BY ALL)) WHERE rank <= 20", *SEEN))
def module_calls(s, d):
    modules = facts.node(s, d).select("path", F.split("path", "/")[0].alias("module")).distinct()
    return P.module_calls(sure(s, d).where("kind = 'calls'"), modules)


@query("impact_headers", oracle(
    "SELECT path, other, min(hop) AS hop FROM (SELECT dst_path AS path, src_path AS other, 1 AS hop FROM inc UNION ALL SELECT a.dst_path, b.src_path, 2 FROM inc a JOIN inc b ON b.dst_path = a.src_path) GROUP BY 1, 2", *SEEN,
    "inc AS (SELECT DISTINCT src_path, dst_path FROM whence WHERE kind = 'includes' AND confidence = 'certain' AND src_path <> dst_path)"))
def impact_headers(s, d):
    """The files that include each file within two steps: those that a change of it reaches."""
    return P.including(sure(s, d).where("kind = 'includes'"))


CHAIN = (
    "card AS (SELECT c_custkey AS card, CASE WHEN c_custkey % 13 = 0 THEN 'isolated_experiment' WHEN c_custkey % 2 = 0 THEN 'formal' END AS artifact_scope, 'b' || c_custkey AS review_bundle, CASE WHEN c_custkey % 11 = 0 THEN 'changed' ELSE 'b' || c_custkey END AS bundle FROM customer)",
    "anchor AS (SELECT c_custkey AS card, c_acctbal > -500 AS valid, CASE WHEN c_acctbal > -500 THEN '' ELSE 'anchor_moved' END AS reason FROM customer WHERE c_custkey % 17 > 0)",
    "experiment AS (SELECT c_custkey AS card, c_custkey % 7 > 0 AS valid, CASE WHEN c_custkey % 7 > 0 THEN '' ELSE 'experiment_stale' END AS reason FROM customer WHERE c_custkey % 3 = 0)",
    "qa AS (SELECT o_custkey AS card, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'passed' END AS status, 'b' || o_custkey AS bundle, CASE WHEN o_totalprice > 400000 THEN 'other' ELSE 'formal' END AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 'agent' ELSE 'human' END AS reviewer_type FROM orders)",
    "review AS (SELECT o_custkey AS card, o_orderkey AS seq, CASE WHEN o_orderpriority LIKE '1%' THEN 'reject' ELSE 'approve' END AS action, CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE 'formal' END AS scope, CASE WHEN o_orderkey % 4 = 0 THEN 'agent' ELSE 'human' END AS reviewer_type FROM orders)",
    "confirmation AS (SELECT o_custkey AS card, 'b' || o_custkey AS bundle, CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'agent' END AS reviewer_type FROM orders WHERE o_orderstatus = 'F')",
    "lastr AS (SELECT card, arg_max((scope, reviewer_type), seq) AS r FROM review WHERE action = 'approve' GROUP BY 1)",
    "chain AS (SELECT c.card, CASE WHEN a.card IS NULL THEN 'anchors_missing' WHEN NOT a.valid THEN a.reason WHEN coalesce(artifact_scope, 'formal') <> 'formal' THEN 'artifact_scope_not_visible' WHEN e.valid = false THEN e.reason WHEN review_bundle <> c.bundle THEN 'review_bundle_changed'"
    " WHEN NOT EXISTS (SELECT 1 FROM qa q WHERE q.card = c.card AND q.bundle = c.bundle AND status = 'passed' AND q.scope = 'formal' AND reviewer_type = 'human') THEN 'qa_no_longer_valid' WHEN l.r IS NULL OR l.r[1] <> 'formal' THEN 'approval_scope_invalid' WHEN l.r[2] <> 'human' THEN 'formal_approval_requires_human'"
    " WHEN NOT EXISTS (SELECT 1 FROM confirmation f WHERE f.card = c.card AND f.bundle = c.bundle AND reviewer_type = 'human') THEN 'formal_approval_requires_current_confirmation' ELSE '' END AS reason FROM card c LEFT JOIN anchor a ON a.card = c.card LEFT JOIN experiment e ON e.card = c.card LEFT JOIN lastr l ON l.card = c.card)",
)


@query("approval_currency", oracle("SELECT card, reason = '' AS valid, reason FROM chain", *CHAIN))
def approval_currency(s, d):
    """Whether the approval of each customer's card still holds, link by link; orders stand for questions, reviews and confirmations."""
    k, text = F.col("c_custkey"), lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    people, orders = table(s, d, "customer"), table(s, d, "orders").withColumn("card", F.col("o_custkey"))
    cards = people.select(k.alias("card"), F.when(k % 13 == 0, "isolated_experiment").when(k % 2 == 0, "formal").alias("artifact_scope"), text("c_custkey").alias("review_bundle"), F.when(k % 11 == 0, "changed").otherwise(text("c_custkey")).alias("bundle"))
    anchors = people.where(k % 17 > 0).select(k.alias("card"), (F.col("c_acctbal") > -500).alias("valid"), F.when(F.col("c_acctbal") > -500, "").otherwise("anchor_moved").alias("reason"))
    experiments = people.where(k % 3 == 0).select(k.alias("card"), (k % 7 > 0).alias("valid"), F.when(k % 7 > 0, "").otherwise("experiment_stale").alias("reason"))
    bundle = text("o_custkey").alias("bundle")
    who = lambda c, yes, no: F.when(c, yes).otherwise(no)
    o = F.col("o_orderkey")
    questions = orders.select("card", who(F.col("o_orderstatus") == "P", "pending", "passed").alias("status"), bundle, who(F.col("o_totalprice") > 400000, "other", "formal").alias("scope"), who(o % 3 == 0, "agent", "human").alias("reviewer_type"))
    reviews = orders.select("card", o.alias("seq"), who(F.col("o_orderpriority").startswith("1"), "reject", "approve").alias("action"), who(o % 19 == 0, "other", "formal").alias("scope"), who(o % 4 == 0, "agent", "human").alias("reviewer_type"))
    confirmations = orders.where("o_orderstatus = 'F'").select("card", bundle, who(o % 2 == 0, "human", "agent").alias("reviewer_type"))
    return V.approved_current(cards, anchors, experiments, questions, reviews, confirmations)
