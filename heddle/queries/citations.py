"""Queries of citations: enriched questions, provenance, validity, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import queries as Q
from heddle.operators import citations as C
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

PHRASES = list(Q.VOCABULARY)
ASKED = "asked AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '解析缓冲区 parserState ' WHEN 1 THEN 'serialize objects ' WHEN 2 THEN '谁调用 getHTTPValues ' ELSE '' END || text AS text FROM conversations)"
RICH = "rich AS (SELECT conv_id, turn, concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(text, '{p}') THEN '{a}' END" for p, a in Q.VOCABULARY.items()) + ") AS text FROM asked)"
PARTS = (
    "idents AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(regexp_replace(array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS p FROM rich)",
    "forms AS (SELECT conv_id, turn, list_concat(p, " + ", ".join(f"CASE WHEN list_contains(p, '{a}') THEN ['{b}'] ELSE [] END" for a, b in Q.ALIASES.items()) + ") AS p FROM idents)",
)


def asked(s, d):
    k = F.col("turn") % 4
    lead = F.when(k == 0, "解析缓冲区 parserState ").when(k == 1, "serialize objects ").when(k == 2, "谁调用 getHTTPValues ").otherwise("")
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("text"))


@query("query_enrichment", oracle("SELECT conv_id, turn, md5(text) AS digest FROM rich", ASKED, RICH))
def query_enrichment(s, d):
    """Every turn, some with a question's words before it, with what the vocabulary adds."""
    return asked(s, d).select("conv_id", "turn", F.md5(Q.enriched("text").cast("binary")).alias("digest"))


@query("query_identifier_parts", oracle("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(p, lambda x: x NOT IN (" + ", ".join(f"'{x}'" for x in Q.STOP) + ")))), ' ') AS parts FROM forms", ASKED, RICH, *PARTS))
def query_identifier_parts(s, d):
    return asked(s, d).select("conv_id", "turn", F.array_join(Q.query_parts("text"), " ").alias("parts"))


@query("identifier_expansion", oracle(
    "SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(array_to_string(regexp_extract_all('fooBar_baz HTTPServer ' || text, '\\b[A-Za-z_][A-Za-z0-9_]{2,}\\b'), ' '), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[_ ]+'), lambda x: length(x) >= 3), lambda x: lower(x)))), ' ')) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '.', 'g') AS text FROM documents) WHERE text IS NOT NULL"))
def identifier_expansion(s, d):
    """Parts of all identifiers of each text, whose letters beyond ASCII part words here."""
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", ".")
    rows = table(s, d, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(Q.expansion(F.concat(F.lit("fooBar_baz HTTPServer "), ascii_)).cast("binary")).alias("digest"))


SOURCE = (
    "src AS (SELECT id, name, 'u' || id AS usr, path, p_size AS line_start, p_size + 20 AS line_end, sha1(name || p_size) AS definition_hash, is_definition FROM node)",
    "cite AS (SELECT l_orderkey AS answer, l_linenumber AS line, l_partkey AS node, CASE l_returnflag WHEN 'R' THEN 'C' WHEN 'N' THEN 'B' ELSE l_returnflag END AS level, l_discount > 0.09 AS stale, CASE WHEN l_tax > 0.07 THEN 'other' ELSE 'repo' END AS repository, CASE l_linestatus WHEN 'F' THEN 'r1' ELSE CASE WHEN l_linenumber = 3 THEN 'r0' ELSE 'r1' END END AS revision, CASE l_returnflag WHEN 'R' THEN 'p' || l_suppkey ELSE 'c' || l_suppkey END AS owner, l_quantity FROM lineitem)",
    "numbered AS (SELECT *, level || row_number() OVER (PARTITION BY answer, level ORDER BY line, node) AS tag FROM cite)",
    "placed AS (SELECT c.*, name AS symbol, usr, path, line_start + (l_quantity::INT % 3) AS line_start, line_end + CASE WHEN l_quantity > 45 THEN 5 ELSE 0 END AS line_end, CASE WHEN l_quantity::INT % 4 > 0 THEN CASE WHEN l_quantity = 9 THEN 'x' ELSE definition_hash END END AS definition_hash FROM numbered c LEFT JOIN src ON src.id = node)",
    "ruled AS (SELECT p.*, NOT stale AND repository = 'repo' AND revision = 'r1' AND CASE level WHEN 'A' THEN coalesce(s.is_definition AND p.line_start >= 1 AND p.line_end >= p.line_start AND s.line_start <= p.line_start AND p.line_end <= s.line_end AND (p.definition_hash IS NULL OR p.definition_hash = s.definition_hash), false) WHEN 'B' THEN owner IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_acctbal > 0) ELSE owner IN (SELECT 'p' || s_suppkey FROM supplier WHERE s_nationkey % 4 > 0) END AS valid FROM placed p LEFT JOIN src s ON s.usr = p.usr AND s.path = p.path)",
    "said AS (SELECT o_orderkey AS answer, CASE o_orderkey % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'see [A1] and [A1]' WHEN 2 THEN '[B1], [A1]' WHEN 3 THEN '[C1] [A9]' ELSE '[A1] [B1] [C1]' END AS text FROM orders)",
)


def sources(s, d):
    return facts.node(s, d).select("id", "name", F.concat(F.lit("u"), F.col("id").cast("string")).alias("usr"), "path", F.col("p_size").alias("line_start"), (F.col("p_size") + 20).alias("line_end"), F.sha1(F.concat("name", F.col("p_size").cast("string")).cast("binary")).alias("definition_hash"), "is_definition")


def cited(s, d):
    """Each order's lines as citations of their parts, with tags by level; lines of one number and part are tagged in the order of the input."""
    from heddle.operators.ranking import top

    rows = table(s, d, "lineitem")
    level = F.when(F.col("l_returnflag") == "R", "C").when(F.col("l_returnflag") == "N", "B").otherwise(F.col("l_returnflag"))
    revision = F.when((F.col("l_linestatus") != "F") & (F.col("l_linenumber") == 3), "r0").otherwise("r1")
    owner = F.concat(F.when(F.col("l_returnflag") == "R", "p").otherwise("c"), F.col("l_suppkey").cast("string"))
    rows = rows.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("node"), level.alias("level"), (F.col("l_discount") > 0.09).alias("stale"),
                       F.when(F.col("l_tax") > 0.07, "other").otherwise("repo").alias("repository"), revision.alias("revision"), owner.alias("owner"), F.col("l_quantity").cast("int").alias("q"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = top(rows, ["answer", "level"], ["line", "node", "file", "at"], name="n").withColumn("tag", F.concat("level", F.col("n").cast("string"))).drop("n", "file", "at")
    placed = C.code_provenance(rows, sources(s, d))
    claimed = F.when(F.col("q") % 4 > 0, F.when(F.col("q") == 9, "x").otherwise(F.col("definition_hash")))
    return placed.withColumn("line_start", F.col("line_start") + F.col("q") % 3).withColumn("line_end", F.col("line_end") + F.when(F.col("q") > 45, 5).otherwise(0)).withColumn("definition_hash", claimed)


def ruled(s, d):
    suppliers = table(s, d, "supplier")
    number = F.col("s_suppkey").cast("string")
    cards = suppliers.select(F.concat(F.lit("c"), number).alias("card"), F.when(F.col("s_acctbal") > 0, "approved").otherwise("stale").alias("status"))
    pages = suppliers.select(F.concat(F.lit("p"), number).alias("page"), F.when(F.col("s_nationkey") % 4 > 0, "ok").otherwise("failed").alias("status"))
    return C.valid(cited(s, d), sources(s, d), cards, pages, "repo", "r1")


@query("citation_validity", oracle(
    "SELECT answer, line, node, tag, valid, level = 'A' AND repository = 'repo' AND revision = 'r1' AND coalesce(usr, '') <> '' AND line_start > 0 AND line_end >= line_start AS complete FROM ruled", *SOURCE))
def citation_validity(s, d):
    """Every citation: whether it still holds, and whether it names its source in full."""
    return ruled(s, d).withColumn("complete", C.complete("repo", "r1")).select("answer", "line", "node", "tag", "valid", "complete")


@query("answer_tags", oracle(
    "SELECT answer, count(tag) AS n_tags, count(tag) > 0 AND bool_and(coalesce(v, false)) AS citation_valid, CASE WHEN count(tag) > 0 AND bool_and(coalesce(v, false)) THEN 'pending_human_review' ELSE 'invalid_citation' END AS answer_correctness FROM (SELECT s.answer, t.tag, r.v FROM said s LEFT JOIN (SELECT DISTINCT answer, unnest(regexp_extract_all(text, '\\[([ABC]\\d+)\\]', 1)) AS tag FROM said) t ON t.answer = s.answer LEFT JOIN (SELECT answer, tag, bool_and(valid) AS v FROM ruled GROUP BY 1, 2) r ON r.answer = s.answer AND r.tag = t.tag) GROUP BY 1", *SOURCE))
def answer_tags(s, d):
    """Answers that cite nothing, what they were given, and what they were not."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "nothing").when(k == 1, "see [A1] and [A1]").when(k == 2, "[B1], [A1]").when(k == 3, "[C1] [A9]").otherwise("[A1] [B1] [C1]")
    return C.answers(table(s, d, "orders").select(F.col("o_orderkey").alias("answer"), text.alias("text")), ruled(s, d).select("answer", "tag", "valid"))


MOVED = (
    "anchored AS (SELECT s_suppkey AS card, p_partkey AS anchor, p_size % 4 > 0 AS active, 'u' || p_partkey AS usr, p_brand || '/' || p_type AS path, p_size - 1 AS line_start, p_size + 19 AS line_end, CASE WHEN p_size % 3 = 0 THEN 'old' ELSE sha1(p_name || p_size) END AS definition_hash FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))",
    "last AS (SELECT * FROM anchored WHERE active QUALIFY row_number() OVER (PARTITION BY card ORDER BY anchor DESC) = 1)",
    "src AS (SELECT id, name, 'u' || id AS usr, path, p_size AS line_start, sha1(name || p_size) AS definition_hash FROM node WHERE is_definition)",
)


@query("card_provenance", oracle(
    "SELECT s.s_suppkey AS card, CASE WHEN s.s_acctbal > 0 THEN 'approved' ELSE 'stale' END AS card_status, n.name AS symbol, l.usr, CASE WHEN n.definition_hash = l.definition_hash THEN n.line_start ELSE l.line_start END AS line_start FROM supplier s LEFT JOIN last l ON l.card = s.s_suppkey LEFT JOIN src n ON n.usr = l.usr", *MOVED))
def card_provenance(s, d):
    """Each supplier's card with its last active anchor; definitions that moved unchanged are cited where they are now."""
    suppliers = table(s, d, "supplier")
    n = suppliers.count()
    cards = suppliers.select(F.col("s_suppkey").alias("card"), F.when(F.col("s_acctbal") > 0, "approved").otherwise("stale").alias("status"))
    own = sources(s, d)
    anchors = own.join(facts.node(s, d).select("id", "p_size"), "id").select(
        (F.col("id") % n).alias("card"), F.col("id").alias("anchor"), (F.col("p_size") % 4 > 0).alias("active"), "usr", "path", (F.col("line_start") - 1).alias("line_start"), (F.col("line_end") - 1).alias("line_end"),
        F.when(F.col("p_size") % 3 == 0, "old").otherwise(F.col("definition_hash")).alias("definition_hash"))
    return C.card_provenance(cards.select("card"), cards, anchors, own).select("card", "card_status", "symbol", "usr", "line_start")
