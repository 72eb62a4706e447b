"""Queries of versions: page states after two generations, invalidation events, uncovered ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import versions as W
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table


def pages(s, d, generation):
    """id, level, input_hash, valid: a page for each node and each path, in two generations."""
    nodes = facts.node(s, d).where("p_size < 45" if generation == 1 else "p_size > 1")
    text = F.concat_ws("|", "name", "kind", (F.when(F.col("p_size") % 5 == 0, F.col("p_size") + generation).otherwise(F.col("p_size"))).cast("string"))
    files = nodes.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.sha1(text.cast("binary")).alias("hash"), "path", (F.col("p_size") != 7).alias("valid"))
    modules = W.rollup(files, "path").select(F.concat(F.lit("m:"), "path").alias("id"), F.lit("module").alias("level"), F.col("hash").alias("input_hash"), F.lit(True).alias("valid"))
    return files.select("id", F.lit("file").alias("level"), F.col("hash").alias("input_hash"), "valid").unionByName(modules)


def generation_sql(g):
    where = "p_size < 45" if g == 1 else "p_size > 1"
    return (
        f"file{g} AS (SELECT 'f' || id AS id, path, sha1(concat_ws('|', name, kind, CASE WHEN p_size % 5 = 0 THEN p_size + {g} ELSE p_size END)) AS hash, p_size <> 7 AS valid FROM node WHERE {where})",
        f"page{g} AS (SELECT id, 'file' AS level, hash, valid FROM file{g} UNION ALL SELECT 'm:' || path, 'module', sha1(concat_ws('|', count(*), sum(('0x' || substr(hash, 1, 12))::BIGINT), sum(('0x' || substr(hash, 13, 12))::BIGINT))), true FROM file{g} GROUP BY path)",
    )


STATES = (*generation_sql(1), *generation_sql(2), "state1 AS (SELECT *, CASE WHEN valid THEN 'ok' ELSE 'failed' END AS status FROM page1)")


@query("page_versions", oracle(
    "SELECT coalesce(n.id, o.id) AS id, coalesce(n.level, o.level) AS level, coalesce(n.hash, o.hash) AS input_hash, CASE WHEN n.id IS NULL THEN 'stale' WHEN o.status = 'ok' AND o.hash = n.hash OR n.valid THEN 'ok' ELSE 'failed' END AS status,"
    " CASE WHEN o.id IS NULL OR n.id IS NULL THEN 1 WHEN o.status = 'ok' AND o.hash = n.hash THEN 1 ELSE 2 END AS version, CASE WHEN n.id IS NULL THEN 'r1' ELSE 'r2' END AS revision FROM state1 o FULL JOIN page2 n ON n.id = o.id", *STATES))
def page_versions(s, d):
    """Pages of files and modules after two generations."""
    first = W.merge(s.createDataFrame([], W.STATE), pages(s, d, 1), "r1").drop("changed")
    return W.merge(first, pages(s, d, 2), "r2").drop("changed")


@query("invalidation_events", oracle(
    "SELECT r.id AS target, path[1] AS trigger, CASE WHEN (SELECT n FROM late) > 0 OR (SELECT count(*) FROM reach) > least(500, greatest(1, 0.3 * (SELECT count(*) FROM both_))) THEN 'full_revalidation' ELSE 'dependency_revalidation' END AS rule, array_to_string(path, '>') AS path, b.before_hash, b.after_hash FROM reach r LEFT JOIN both_ b ON b.id = path[1]",
    *generation_sql(1), *generation_sql(2),
    "both_ AS MATERIALIZED (SELECT coalesce(b.id, a.id) AS id, b.hash AS before_hash, a.hash AS after_hash FROM file1 b FULL JOIN file2 a ON a.id = b.id)",
    "uses AS MATERIALIZED (SELECT id AS at, 'm:' || path AS id FROM file1 UNION SELECT 'm:' || path, 'b:' || split_part(path, '/', 1) FROM file1 UNION SELECT 'b:' || split_part(path, '/', 1), 'repo' FROM file1)",
    "reach(id, depth, path) USING KEY (id) AS (SELECT id, 0, [id] FROM both_ WHERE before_hash IS DISTINCT FROM after_hash UNION SELECT u.id, max(r.depth) + 1, list_append(min(r.path), u.id) FROM reach r JOIN uses u ON u.at = r.id LEFT JOIN recurring.reach x ON x.id = u.id WHERE x.id IS NULL GROUP BY u.id)",
    "late AS (SELECT count(*) AS n FROM reach a JOIN uses u ON u.at = a.id JOIN reach b ON b.id = u.id WHERE a.depth >= 2 AND (b.depth > a.depth OR b.depth = a.depth AND b.path > a.path))"))
def invalidation_events(s, d):
    """What changed files make invalid: themselves, their modules, brands and the repository, each with the path that led there."""
    before, after = (pages(s, d, g).where("level = 'file'").select("id", F.col("input_hash").alias("hash")) for g in (1, 2))
    nodes = facts.node(s, d).where("p_size < 45")
    module, brand = F.concat(F.lit("m:"), "path"), F.concat(F.lit("b:"), F.split("path", "/")[0])
    steps = [nodes.select(a.alias("child"), b.alias("parent")) for a, b in ((F.concat(F.lit("f"), F.col("id").cast("string")), module), (module, brand), (brand, F.lit("repo")))]
    return W.invalidations(before, after, steps[0].unionByName(steps[1]).unionByName(steps[2]))


RANGES = (
    "need AS (SELECT s_suppkey AS key, 0 AS first, (SELECT max(p_partkey) FROM part) AS last FROM supplier UNION ALL SELECT s_suppkey, 10, 20 FROM supplier)",
    "have AS (SELECT l_suppkey AS key, l_partkey AS first, l_partkey + l_quantity::BIGINT - 1 AS last FROM lineitem)",
    "line AS (SELECT DISTINCT key, unnest(range(first, last + 1)) AS n FROM need)", "held AS (SELECT DISTINCT key, unnest(range(first, last + 1)) AS n FROM have)",
    "open_ AS (SELECT key, n, n - row_number() OVER (PARTITION BY key ORDER BY n) AS g FROM line WHERE (key, n) NOT IN (SELECT (key, n) FROM held))",
)


@query("range_gaps", oracle("SELECT key, min(n) AS first, max(n) AS last FROM open_ GROUP BY key, g", *RANGES))
def range_gaps(s, d):
    """Stretches of part numbers that no delivery of a supplier covers; a delivery covers as many numbers as its quantity."""
    most = table(s, d, "part").agg(F.max("p_partkey").alias("last"))
    suppliers = table(s, d, "supplier").select(F.col("s_suppkey").alias("key"))
    long = lambda x: F.lit(x).cast("bigint")
    need = suppliers.crossJoin(F.broadcast(most)).select("key", long(0).alias("first"), "last").unionByName(suppliers.select("key", long(10).alias("first"), long(20).alias("last")))
    have = table(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") - 1).alias("last"))
    return W.gaps(need, have, "key", "first", "last")
