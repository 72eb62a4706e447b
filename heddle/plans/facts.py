"""Fact views over the input tables: nodes, observed edges, chunks, postings, questions, trials.

Each view is a lazy DataFrame; PRELUDE holds the same definitions as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.text import terms
from heddle.operators.ranking import small, spread
from heddle.sources.tables import table

NAME_TERMS = 6

PRELUDE = r"""
node AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand || '/' || p_type AS path, p_size % 2 = 1 AS is_definition, p_size FROM part),
obs AS (SELECT l_orderkey AS tu, l_linenumber AS ln, min(l_partkey) AS p, max(l_returnflag) AS rf FROM lineitem GROUP BY 1, 2),
nexts AS (SELECT tu, ln, p, rf, lead(p) OVER (PARTITION BY tu ORDER BY ln) AS q FROM obs),
edge_obs AS (SELECT tu, p AS src, q AS dst, CASE rf WHEN 'R' THEN 'candidate' ELSE 'certain' END AS confidence FROM nexts WHERE q IS NOT NULL AND q <> p),
typed AS (SELECT DISTINCT p AS src, q AS dst, CASE WHEN ln <= 2 THEN 'calls' WHEN ln = 3 THEN 'type_use' WHEN ln = 4 THEN 'field_access' WHEN ln = 5 THEN 'global_ref' ELSE 'includes' END AS kind FROM nexts WHERE q IS NOT NULL AND q <> p AND rf <> 'R'),
edge AS (SELECT src, dst, confidence, count(DISTINCT tu) AS n_obs FROM edge_obs GROUP BY 1, 2, 3),
certain AS (SELECT DISTINCT src, dst FROM edge_obs WHERE confidence = 'certain'),
chunk AS (SELECT d.doc_id AS rowid, d.text, d.source, d.lang, CASE WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'B' ELSE 'C' END AS level, coalesce(l.toxic, 0) = 0 AS visible FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
token AS (SELECT rowid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunk WHERE visible),
posting AS MATERIALIZED (SELECT rowid, term, count(*) AS tf FROM token GROUP BY 1, 2),
doclen AS (SELECT rowid, sum(tf) AS dl FROM posting GROUP BY 1),
question AS (SELECT item_id AS qid, text FROM benchmark),
qterm AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')[1:12]) AS term FROM question),
df AS (SELECT term, count(*) AS n FROM posting GROUP BY 1),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM doclen),
bm25_all AS MATERIALIZED (SELECT q.qid, p.rowid, round(sum(greatest(ln((c.n_docs - d.n + 0.5) / (d.n + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl))), 6) AS score
  FROM qterm q JOIN posting p ON q.term = p.term JOIN df d ON d.term = p.term JOIN doclen l ON l.rowid = p.rowid, corpus c GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM bm25_all) WHERE rank <= 30),
symbol AS (SELECT rowid, array_to_string(t[1:6], '_') AS name, concat_ws('/', source, lang) AS path, lower(source) AS file FROM (SELECT rowid, source, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM chunk WHERE visible) WHERE len(t) > 0),
qname AS (SELECT item_id AS qid, array_to_string(t[1:6], '_') AS full_name, array_to_string(t[1:2], '_') || '_' AS start FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark) WHERE len(t) >= 6),
links AS (SELECT src, dst FROM certain WHERE src IN (SELECT rowid FROM chunk WHERE visible) AND dst IN (SELECT rowid FROM chunk WHERE visible)),
trial AS (SELECT c_custkey AS task, c_mktsegment AS mechanism, n_regionkey AS repository, o_orderstatus AS arm, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
run_event AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, event_type AS tool, value, ts FROM events)
"""


def oracle(body: str, *more: str) -> str:
    """Oracle SQL: the views, further named queries, and the body."""
    return "WITH RECURSIVE " + ", ".join([PRELUDE.strip(), *more]) + " " + body


def rollup_sql(child: str, content: str) -> str:
    """The hash of `incremental.merkle` over the rows of a group."""
    h = f"sha1(concat_ws(':', {child}, {content}))"
    return f"sha1(concat_ws('|', count(*), sum(('0x' || substr({h}, 1, 12))::BIGINT), sum(('0x' || substr({h}, 13, 12))::BIGINT)))"


def node(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
        F.concat_ws("/", "p_brand", "p_type").alias("path"), (F.col("p_size") % 2 == 1).alias("is_definition"), "p_size",
    )


def edge_obs(s: SparkSession, d: str) -> DataFrame:
    """Observed edges: consecutive parts of an order."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("tu"), F.col("l_linenumber").alias("ln"), "l_partkey", "l_returnflag").repartition("tu")  # once, for groups and windows
    sites = lines.groupBy("tu", "ln").agg(F.min("l_partkey").alias("src"), F.max("l_returnflag").alias("rf"))
    nexts = sites.withColumn("dst", F.lead("src").over(Window.partitionBy("tu").orderBy("ln")))
    confidence = F.when(F.col("rf") == "R", "candidate").otherwise("certain").alias("confidence")
    return nexts.where("dst is not null and dst <> src").select("tu", "src", "dst", confidence)


def seen(s: SparkSession, d: str) -> DataFrame:
    """tu, seq, src, dst, kind, confidence, reason: observed relations by kind, each with the reason its line gives."""
    sites = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("tu"), F.col("l_linenumber").alias("seq")).agg(
        F.min("l_partkey").alias("src"), F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls")
    )
    nexts = sites.withColumn("dst", F.lead("src").over(Window.partitionBy("tu").orderBy("seq"))).where("dst is not null and dst <> src")
    kind = F.when(F.col("seq") <= 2, "calls").when(F.col("seq") == 3, "type_use").when(F.col("seq") == 4, "field_access").when(F.col("seq") == 5, "global_ref").otherwise("includes")
    return nexts.select("tu", "seq", "src", "dst", kind.alias("kind"), F.when(F.col("rf") == "R", "candidate").otherwise("certain").alias("confidence"), F.concat_ws(":", "ls", F.col("seq").cast("string")).alias("reason"))


def typed(s: SparkSession, d: str) -> DataFrame:
    """src, dst, kind: confirmed relations, their kind by the place in the order."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("tu"), F.col("l_linenumber").alias("ln"), "l_partkey", "l_returnflag").repartition("tu")
    sites = lines.groupBy("tu", "ln").agg(F.min("l_partkey").alias("src"), F.max("l_returnflag").alias("rf"))
    nexts = sites.withColumn("dst", F.lead("src").over(Window.partitionBy("tu").orderBy("ln")))
    ln = F.col("ln")
    kind = F.when(ln <= 2, "calls").when(ln == 3, "type_use").when(ln == 4, "field_access").when(ln == 5, "global_ref").otherwise("includes")
    return nexts.where("dst is not null and dst <> src and rf <> 'R'").select("src", "dst", kind.alias("kind")).distinct()


def edge(s: SparkSession, d: str) -> DataFrame:
    from heddle.operators.graph import dedup_edges

    return dedup_edges(edge_obs(s, d))


def certain(s: SparkSession, d: str) -> DataFrame:
    return edge_obs(s, d).where("confidence = 'certain'").select("src", "dst").distinct()


def chunk(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", "source", "lang")
    level = F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "B").otherwise("C")
    return docs.join(table(s, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("rowid"), "text", "source", "lang", level.alias("level"), (F.coalesce("toxic", F.lit(0)) == 0).alias("visible")
    )


def postings(s: SparkSession, d: str) -> DataFrame:
    """rowid, term, tf of visible chunks: hidden rows never reach the index."""
    rows = chunk(s, d).where("visible").select("rowid", F.explode(terms("text")).alias("term"))
    return rows.groupBy("rowid", "term").agg(F.count("*").alias("tf"))


def shown(s: SparkSession, d: str) -> DataFrame:
    """The visible chunks, on all cores: a file of few row groups is read by as few tasks."""
    return spread(chunk(s, d).where("visible"), table(s, d, "documents"), "rowid")


def matched(s: SparkSession, d: str, query: DataFrame) -> DataFrame:
    """rowid, term, tf, dl of visible chunks, only for terms that a question holds: one pass over the texts."""
    rows = shown(s, d).select("rowid", terms("text").alias("all")).select("rowid", F.size("all").alias("dl"), F.explode("all").alias("term"))
    return rows.join(small(query.select("term").distinct()), "term", "left_semi").groupBy("rowid", "term", "dl").agg(F.count("*").alias("tf"))


def meta(s: SparkSession, d: str) -> DataFrame:
    """rowid, level, file, path, chars, dl, name of visible chunks, without their texts: one pass serves sizes, symbols and features.

    A chunk is named by its first NAME_TERMS terms and stands in source/lang.
    """
    rows = shown(s, d).select("*", terms("text").alias("t"))
    return rows.select(
        "rowid", "level", F.lower("source").alias("file"), F.concat_ws("/", "source", "lang").alias("path"), F.length("text").alias("chars"),
        F.size("t").alias("dl"), F.array_join(F.slice("t", 1, NAME_TERMS), "_").alias("name"))


def corpus(meta: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl of the chunks that hold a term."""
    return meta.where("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def links(s: SparkSession, d: str, meta: DataFrame) -> DataFrame:
    """src, dst: confirmed edges between visible chunks (a chunk is the node of its number)."""
    rows = edge_obs(s, d).where("confidence = 'certain'").select("src", "dst")
    for end in ("src", "dst"):
        rows = rows.join(small(meta.select(F.col("rowid").alias(end))), end, "left_semi")
    return rows.select("src", "dst").distinct()


def question(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def trial(s: SparkSession, d: str) -> DataFrame:
    people = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(s, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("mechanism"), F.col("n_regionkey").alias("repository"),
        F.col("o_orderstatus").alias("arm"), F.col("o_totalprice").alias("value"),
    )


def run_event(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(order).cast("bigint").alias("ordinal"), F.col("event_type").alias("tool"), "value", "ts"
    )
