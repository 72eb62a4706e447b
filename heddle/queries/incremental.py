"""Incremental queries: plans, retraction, roll-ups, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import incremental as I
from heddle.operators.dependencies import propagate
from heddle.operators.graph import dedup_edges
from heddle.plans import facts
from heddle.plans.facts import oracle, rollup_sql
from heddle.registry import query
from heddle.sources.tables import table

CUT = "1998-01-01"
VERSIONS = (
    f"v1 AS (SELECT o_custkey AS k, count(*) AS n, sum(o_orderkey) AS h FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1)",
    "v2 AS (SELECT o_custkey AS k, count(*) AS n, sum(o_orderkey) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)",
)


def versions(s, d):
    """Two snapshots of a customer's orders: before the cut date, and without pending ones."""
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("k"), "o_orderdate")
    at = F.lit(CUT).cast("timestamp_ntz")
    return [I.fingerprints(x, "k", ["o_orderkey"]) for x in (orders.where(F.col("o_orderdate") < at), orders.where("o_orderstatus <> 'P'"))]


@query("tu_fingerprint", oracle("SELECT tu, sha1(string_agg(src || '>' || dst || ':' || confidence, '|' ORDER BY src, dst, confidence)) AS fingerprint FROM edge_obs GROUP BY 1"))
def tu_fingerprint(s, d):
    parts = F.array_sort(F.collect_list(F.struct("src", "dst", "confidence")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"), F.lit(":"), x["confidence"])), "|")
    return facts.edge_obs(s, d).groupBy("tu").agg(F.sha1(text.cast("binary")).alias("fingerprint"))


@query("increment_plan", oracle("SELECT coalesce(v1.k, v2.k) AS k, CASE WHEN v1.k IS NULL THEN 'new' WHEN v2.k IS NULL THEN 'removed' WHEN v1.n = v2.n AND v1.h = v2.h THEN 'reuse' ELSE 'changed' END AS action FROM v1 FULL JOIN v2 ON v1.k = v2.k", *VERSIONS))
def increment_plan(s, d):
    return I.plan(*versions(s, d), "k")


@query("snapshot_diff", oracle("SELECT coalesce(a.k, b.k) AS k, a.n AS before, b.n AS after FROM v1 a FULL JOIN v2 b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n", *VERSIONS))
def snapshot_diff(s, d):
    orders = table(s, d, "orders")
    count = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return I.changes(count(orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))), count(orders.where("o_orderstatus <> 'P'")), "k", "n")


GONE = "gone AS (SELECT o_orderkey AS tu FROM orders WHERE o_orderstatus = 'P')"


@query("retract_edges", oracle("SELECT src, dst, confidence, count(DISTINCT tu) AS n_obs FROM edge_obs WHERE tu NOT IN (SELECT tu FROM gone) GROUP BY 1, 2, 3", GONE))
def retract_edges(s, d):
    gone = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tu"))
    return I.retract(facts.edge_obs(s, d), gone)


CHANGED = "changed AS (SELECT tu, CASE WHEN tu IN (SELECT tu FROM gone) THEN dst ELSE src END AS src, CASE WHEN tu IN (SELECT tu FROM gone) THEN src ELSE dst END AS dst, confidence FROM edge_obs)"


@query("rebuild_equivalence", oracle("SELECT confidence, count(*) AS n_edges, sum(n_obs)::BIGINT AS n_obs, sum(src * 31 + dst)::BIGINT AS ends FROM (SELECT src, dst, confidence, count(DISTINCT tu) AS n_obs FROM changed GROUP BY 1, 2, 3) GROUP BY 1", GONE, CHANGED))
def rebuild_equivalence(s, d):
    """Edges by confidence after pending orders were read anew with every edge turned; SQL rebuilds all from the changed units."""
    observed = facts.edge_obs(s, d)
    again = observed.join(table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tu")), "tu", "left_semi").select("tu", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    return dedup_edges(I.refresh(observed, again)).groupBy("confidence").agg(F.count("*").alias("n_edges"), F.sum("n_obs").alias("n_obs"), F.sum(F.col("src") * 31 + F.col("dst")).alias("ends"))


@query("orphan_nodes", oracle("SELECT id, name FROM node WHERE id NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge)"))
def orphan_nodes(s, d):
    edges = facts.edge_obs(s, d)
    used = edges.select(F.explode(F.array("src", "dst")).alias("used")).distinct()
    return I.orphans(facts.node(s, d).select("id", "name"), "id", used, "used")


@query("orphan_edges", oracle("SELECT tu, src, dst FROM edge_obs WHERE tu NOT IN (SELECT o_orderkey FROM orders)"))
def orphan_edges(s, d):
    return I.orphans(facts.edge_obs(s, d).select("tu", "src", "dst"), "tu", table(s, d, "orders"), "o_orderkey")


HELD = "sha1(c_name || ':' || c_mktsegment)"
FILES = f"files AS (SELECT c_nationkey AS nation, count(*) AS n_children, {rollup_sql('c_custkey', HELD)} AS hash FROM customer GROUP BY 1)"
MODULES = f"modules AS (SELECT n_regionkey AS region, count(*) AS n_children, {rollup_sql('nation', 'hash')} AS hash FROM files JOIN nation ON n_nationkey = nation GROUP BY 1)"


def merkle_files(s, d):
    leaves = table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.sha1(F.concat_ws(":", "c_name", "c_mktsegment").cast("binary")).alias("hash"))
    return I.merkle(leaves, "nation", "c_custkey")


def merkle_modules(s, d):
    up = merkle_files(s, d).join(table(s, d, "nation"), F.col("nation") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "nation", "hash")
    return I.merkle(up, "region", "nation")


@query("merkle_file", oracle("SELECT nation, n_children, hash FROM files", FILES))
def merkle_file(s, d):
    return merkle_files(s, d)


@query("merkle_module", oracle("SELECT region, n_children, hash FROM modules", FILES, MODULES))
def merkle_module(s, d):
    return merkle_modules(s, d)


@query("merkle_repo", oracle(f"SELECT 'repo' AS repo, count(*) AS n_children, {rollup_sql('region', 'hash')} AS hash FROM modules", FILES, MODULES))
def merkle_repo(s, d):
    return I.merkle(merkle_modules(s, d).withColumn("repo", F.lit("repo")), "repo", "region")


@query("propagate_changes", oracle(
    "SELECT id, depth, array_to_string(path, '>') AS path FROM (SELECT * FROM debt UNION ALL SELECT * FROM nations UNION ALL SELECT 'r' || n_regionkey, 2, list_append(min(path), 'r' || n_regionkey) FROM nations JOIN nation ON 'n' || n_nationkey = id GROUP BY n_regionkey)",
    "debt AS (SELECT 'c' || c_custkey AS id, 0 AS depth, ['c' || c_custkey] AS path FROM customer WHERE c_acctbal < 0)",
    "nations AS (SELECT 'n' || c_nationkey AS id, 1 AS depth, list_append(min(path), 'n' || c_nationkey) AS path FROM debt JOIN customer ON 'c' || c_custkey = id GROUP BY c_nationkey)"))
def propagate_changes(s, d):
    """What depends on customers in debt: their nations, and those nations' regions."""
    tagged = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    people = table(s, d, "customer")
    consumers = people.select(tagged("c", "c_custkey").alias("child"), tagged("n", "c_nationkey").alias("parent")).unionByName(
        table(s, d, "nation").select(tagged("n", "n_nationkey").alias("child"), tagged("r", "n_regionkey").alias("parent")))
    return propagate(people.where("c_acctbal < 0").select(tagged("c", "c_custkey").alias("id")), consumers, people.count()).drop("mode")


@query("dependency_check", oracle("SELECT s_suppkey AS owner, CASE WHEN n_nationkey IS NULL THEN 'missing' WHEN s_acctbal < 0 THEN 'changed' ELSE 'current' END AS state FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"))
def dependency_check(s, d):
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    state = F.when(F.col("n_nationkey").isNull(), "missing").when(F.col("s_acctbal") < 0, "changed").otherwise("current")
    return rows.select(F.col("s_suppkey").alias("owner"), state.alias("state"))


@query("dead_observations", oracle("SELECT confidence, count(*) AS n_edges FROM (SELECT src, dst, confidence FROM edge_obs GROUP BY ALL HAVING count(DISTINCT tu) FILTER (tu NOT IN (SELECT tu FROM gone)) = 0) GROUP BY 1", GONE))
def dead_observations(s, d):
    """Edges that only pending orders observe, by confidence."""
    gone = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tu"))
    live = I.retract(facts.edge_obs(s, d), gone)
    return dedup_edges(facts.edge_obs(s, d)).join(live, ["src", "dst", "confidence"], "left_anti").groupBy("confidence").agg(F.count("*").alias("n_edges"))
