"""Graph queries: edges, traversal, impact, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import identifier_parts, module_of
from heddle.operators import graph as G
from heddle.operators.ranking import top
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

WALK = {
    False: "walk AS (SELECT src AS seed, dst AS id, 1 AS hop FROM certain UNION SELECT w.seed, e.dst, w.hop + 1 FROM walk w JOIN certain e ON e.src = w.id WHERE w.hop < 2)",
    True: "walk AS (SELECT dst AS seed, src AS id, 1 AS hop FROM certain UNION SELECT w.seed, e.src, w.hop + 1 FROM walk w JOIN certain e ON e.dst = w.id WHERE w.hop < 2)",
}
REACHED = "reached AS (SELECT seed, id, min(hop) AS hop FROM walk GROUP BY 1, 2)"
MODULE = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END"


@query("edge_dedup", oracle("SELECT src, dst, confidence, n_obs FROM edge"))
def edge_dedup(s: SparkSession, d: str) -> DataFrame:
    return facts.edge(s, d)


@query("edge_observations", oracle("SELECT tu, src, dst, confidence, count(*) AS n FROM edge_obs GROUP BY ALL"))
def edge_observations(s, d):
    return facts.edge_obs(s, d).groupBy("tu", "src", "dst", "confidence").agg(F.count("*").alias("n"))


@query("node_definition_wins", oracle("SELECT id, name, kind, path, is_definition, p_size FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_definition DESC, id) AS r FROM node) WHERE r = 1"))
def node_definition_wins(s, d):
    return G.definition_wins(facts.node(s, d))


@query("neighbors_out_2hop", oracle("SELECT seed, id, hop FROM reached", WALK[False], REACHED))
def neighbors_out_2hop(s, d):
    return G.neighbors(facts.certain(s, d), 2)


@query("neighbors_in_2hop", oracle("SELECT seed, id, hop FROM reached", WALK[True], REACHED))
def neighbors_in_2hop(s, d):
    return G.neighbors(facts.certain(s, d), 2, reverse=True)


@query("impact_by_hop", oracle("SELECT seed, hop, count(*) AS n FROM reached GROUP BY 1, 2", WALK[True], REACHED))
def impact_by_hop(s, d):
    return G.neighbors(facts.certain(s, d), 2, reverse=True).groupBy("seed", "hop").agg(F.count("*").alias("n"))


@query("impact_files", oracle("SELECT seed, count(DISTINCT path) AS n_files, min(path) AS first_file FROM reached JOIN node USING (id) GROUP BY 1", WALK[True], REACHED))
def impact_files(s, d):
    reached = G.neighbors(facts.certain(s, d), 2, reverse=True)
    return reached.join(facts.node(s, d), "id").groupBy("seed").agg(F.countDistinct("path").alias("n_files"), F.min("path").alias("first_file"))


@query("impact_modules", oracle(f"SELECT seed, string_agg(DISTINCT m, ',' ORDER BY m) AS modules FROM (SELECT seed, {MODULE} AS m FROM reached JOIN node USING (id)) GROUP BY 1", WALK[True], REACHED))
def impact_modules(s, d):
    named = G.neighbors(facts.certain(s, d), 2, reverse=True).join(facts.node(s, d).select("id", module_of("path").alias("m")), "id")
    return named.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("modules"))


@query("impact_candidates", oracle("SELECT dst AS seed, count(DISTINCT src) AS n_candidates FROM edge WHERE confidence = 'candidate' GROUP BY 1"))
def impact_candidates(s, d):
    return facts.edge(s, d).where("confidence = 'candidate'").groupBy(F.col("dst").alias("seed")).agg(F.countDistinct("src").alias("n_candidates"))


@query("callchain_subgraph", oracle(
    "SELECT m.seed, count(*) AS n_edges, sum(CASE confidence WHEN 'candidate' THEN 1 ELSE 0 END)::BIGINT AS n_candidate FROM member m JOIN edge e ON e.src = m.id JOIN member o ON o.seed = m.seed AND o.id = e.dst GROUP BY 1",
    "member AS (SELECT src AS seed, dst AS id FROM certain UNION SELECT src, src FROM certain)"))
def callchain_subgraph(s, d):
    sub = G.subgraph(G.neighbors(facts.certain(s, d), 1), facts.edge(s, d))
    return sub.groupBy("seed").agg(F.count("*").alias("n_edges"), F.sum((F.col("confidence") == "candidate").cast("bigint")).alias("n_candidate"))


@query("fan_in_out", oracle("SELECT coalesce(i.id, o.id) AS id, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out FROM (SELECT dst AS id, count(*) AS fan_in FROM certain GROUP BY 1) i FULL JOIN (SELECT src AS id, count(*) AS fan_out FROM certain GROUP BY 1) o ON i.id = o.id"))
def fan_in_out(s, d):
    return G.fan_in_out(facts.certain(s, d))


@query("direct_edges_reason", oracle("SELECT e.src, e.dst, n.name, e.confidence, CASE WHEN confidence = 'candidate' THEN 'unresolved' WHEN n_obs > 1 THEN 'repeated' ELSE 'single' END AS reason FROM edge e JOIN node n ON n.id = e.dst"))
def direct_edges_reason(s, d):
    reason = F.when(F.col("confidence") == "candidate", "unresolved").when(F.col("n_obs") > 1, "repeated").otherwise("single")
    named = facts.node(s, d).select(F.col("id").alias("dst"), "name")
    return facts.edge(s, d).join(named, "dst").select("src", "dst", "name", "confidence", reason.alias("reason"))


@query("resolve_symbol", oracle("SELECT name, count(*) AS n_matches, min(id) AS first_id, count(*) > 1 AS ambiguous FROM node GROUP BY 1"))
def resolve_symbol(s, d):
    return facts.node(s, d).groupBy("name").agg(F.count("*").alias("n_matches"), F.min("id").alias("first_id"), (F.count("*") > 1).alias("ambiguous"))


@query("resolve_file_unique", oracle("SELECT kind AS suffix, count(DISTINCT path) AS n_paths, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path FROM node GROUP BY 1"))
def resolve_file_unique(s, d):
    rows = facts.node(s, d).groupBy(F.col("kind").alias("suffix")).agg(F.countDistinct("path").alias("n_paths"), F.min("path").alias("p"))
    return rows.select("suffix", "n_paths", F.when(F.col("n_paths") == 1, F.col("p")).alias("path"))


@query("module_of", oracle(f"SELECT id, {MODULE} AS module FROM node"))
def module_of_node(s, d):
    return facts.node(s, d).select("id", module_of("path").alias("module"))


@query("repo_outline", oracle(f"SELECT {MODULE} AS module, count(DISTINCT path) AS n_files, count(*) AS n_nodes, sum(CASE WHEN is_definition THEN 1 ELSE 0 END)::BIGINT AS n_definitions FROM node GROUP BY 1"))
def repo_outline(s, d):
    rows = facts.node(s, d).groupBy(module_of("path").alias("module"))
    return rows.agg(F.countDistinct("path").alias("n_files"), F.count("*").alias("n_nodes"), F.sum(F.col("is_definition").cast("bigint")).alias("n_definitions"))


def placed(s, d) -> DataFrame:
    """Confirmed edges with the paths of both ends."""
    path = facts.node(s, d).select("id", "path")
    out = facts.certain(s, d).join(path.select(F.col("id").alias("src"), F.col("path").alias("a")), "src")
    return out.join(path.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")


PLACED = "placed AS (SELECT c.src, c.dst, x.path AS a, y.path AS b FROM certain c JOIN node x ON x.id = c.src JOIN node y ON y.id = c.dst)"


@query("cross_file_calls", oracle("SELECT a AS src_path, b AS dst_path, count(*) AS n FROM placed WHERE a <> b GROUP BY 1, 2", PLACED))
def cross_file_calls(s, d):
    return placed(s, d).where("a <> b").groupBy(F.col("a").alias("src_path"), F.col("b").alias("dst_path")).agg(F.count("*").alias("n"))


@query("include_matrix", oracle("SELECT regexp_replace(a, '/[^/]*$', '') AS src_module, regexp_replace(b, '/[^/]*$', '') AS dst_module, count(*) AS n FROM placed GROUP BY 1, 2", PLACED))
def include_matrix(s, d):
    return placed(s, d).groupBy(module_of("a").alias("src_module"), module_of("b").alias("dst_module")).agg(F.count("*").alias("n"))


@query("file_card_symbols", oracle("SELECT path, count(*) AS n_symbols, min(name) AS first_name, max(p_size)::BIGINT AS largest FROM node GROUP BY 1"))
def file_card_symbols(s, d):
    return facts.node(s, d).groupBy("path").agg(F.count("*").alias("n_symbols"), F.min("name").alias("first_name"), F.max("p_size").cast("bigint").alias("largest"))


@query("file_card_calls", oracle("SELECT path, sum(o)::BIGINT AS calls_out, sum(i)::BIGINT AS calls_in FROM (SELECT a AS path, 1 AS o, 0 AS i FROM placed WHERE a <> b UNION ALL SELECT b, 0, 1 FROM placed WHERE a <> b) GROUP BY 1", PLACED))
def file_card_calls(s, d):
    ends = F.explode(F.array(F.struct(F.col("a").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return placed(s, d).where("a <> b").select(ends.alias("e")).groupBy("e.path").agg(F.sum("e.o").alias("calls_out"), F.sum("e.i").alias("calls_in"))


@query("summary_head_lists", oracle(
    "SELECT id, coalesce(string_agg(name, ';' ORDER BY name) FILTER (r <= 12), '') AS callees, count(*) AS n_callees FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY name) AS r FROM (SELECT DISTINCT c.src AS id, n.name FROM certain c JOIN node n ON n.id = c.dst)) GROUP BY 1"))
def summary_head_lists(s, d):
    named = facts.certain(s, d).join(facts.node(s, d).select(F.col("id").alias("dst"), "name"), "dst")
    lists = named.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("l"))
    return lists.select("id", F.array_join(F.slice("l", 1, 12), ";").alias("callees"), F.size("l").cast("bigint").alias("n_callees"))


@query("stats_snapshot", oracle("SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM node WHERE is_definition) AS definitions, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE confidence = 'candidate') AS candidates, (SELECT count(*) FROM chunk) AS chunks, (SELECT count(*) FROM chunk WHERE NOT visible) AS hidden, (SELECT count(*) FROM question) AS questions"))
def stats_snapshot(s, d):
    one = lambda df, **aggs: df.agg(*(v.alias(k) for k, v in aggs.items()))
    some = lambda c: F.count(F.when(c, 1))
    out = one(facts.node(s, d), nodes=F.count("*"), definitions=some(F.col("is_definition")))
    for part in (
        one(facts.edge(s, d), edges=F.count("*"), candidates=some(F.col("confidence") == "candidate")),
        one(facts.chunk(s, d), chunks=F.count("*"), hidden=some(~F.col("visible"))), one(facts.question(s, d), questions=F.count("*")),
    ):
        out = out.join(F.broadcast(part), F.lit(True))  # single rows
    return out


@query("edge_kind_gates", oracle("SELECT confidence, count(*) AS n_edges, sum(n_obs)::BIGINT AS n_obs, count(*) > 0 AS present, max(n_obs) AS most_seen FROM edge GROUP BY 1"))
def edge_kind_gates(s, d):
    return facts.edge(s, d).groupBy("confidence").agg(F.count("*").alias("n_edges"), F.sum("n_obs").alias("n_obs"), (F.count("*") > 0).alias("present"), F.max("n_obs").alias("most_seen"))


@query("hub_nodes", oracle("SELECT id, fan_in, rank FROM (SELECT dst AS id, count(*) AS fan_in, row_number() OVER (ORDER BY count(*) DESC, dst) AS rank FROM certain GROUP BY 1) WHERE rank <= 15"))
def hub_nodes(s, d):
    """The 15 nodes with most callers."""
    counts = facts.certain(s, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return top(counts.orderBy(F.desc("fan_in"), "id").limit(15).withColumn("k", F.lit(0)), "k", [F.desc("fan_in"), "id"]).drop("k")


@query("identifier_parts", oracle("SELECT DISTINCT p_name AS name, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2))), ',') AS parts FROM part"))
def parts_of_names(s, d):
    return table(s, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.array_join(identifier_parts("name"), ",").alias("parts"))


@query("symbol_tiers", oracle(
    "SELECT qname, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY tier, id) AS rank FROM (SELECT qname, id, min(tier) AS tier FROM hits GROUP BY 1, 2)) WHERE rank <= 30",
    "qn AS (SELECT DISTINCT name AS qname FROM node)",
    "hits AS (SELECT qname, id, 1 AS tier FROM qn JOIN node ON name = qname UNION ALL SELECT qname, id, 2 FROM qn JOIN node ON split_part(name, ' ', 1) = split_part(qname, ' ', 1))"))
def symbol_tiers(s, d):
    """Symbol recall in tiers: the exact name, then the same first word; keep-first, the best 30."""
    nodes = facts.node(s, d).select("id", "name", F.split("name", " ")[0].alias("word"))
    names = nodes.select(F.col("name").alias("qname"), F.col("word").alias("qword")).distinct()
    exact = names.join(nodes, F.col("name") == F.col("qname")).select("qname", "id", F.lit(1).alias("tier"))
    prefix = names.join(nodes, F.col("word") == F.col("qword")).select("qname", "id", F.lit(2).alias("tier"))
    best = exact.unionByName(prefix).groupBy("qname", "id").agg(F.min("tier").alias("tier"))
    return top(best, "qname", ["tier", "id"], 30)


@query("one_per_file", oracle("SELECT path, id, fan_in FROM (SELECT n.path, n.id, f.fan_in, row_number() OVER (PARTITION BY n.path ORDER BY f.fan_in DESC, n.id) AS r FROM node n JOIN (SELECT dst AS id, count(*) AS fan_in FROM certain GROUP BY 1) f ON f.id = n.id) WHERE r = 1"))
def one_per_file(s, d):
    fan = facts.certain(s, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return top(facts.node(s, d).join(fan, "id").select("path", "id", "fan_in"), "path", [F.desc("fan_in"), "id"], 1).drop("rank")
