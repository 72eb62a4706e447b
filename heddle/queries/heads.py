"""Queries of summary heads and review measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import evaluation as V
from heddle.operators import heads as H
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.queries.pages import SEEN, sure
from heddle.registry import query
from heddle.sources.tables import table

# The lists of a head before its trimming, and the trimming as a walk of at most twenty steps.
CUTS = ("callees", "callers", "headers", "key_types", "pitfalls")
LINES = ("'### ' || name || ' — ' || one_liner", *(f"CASE WHEN len({k}) > 0 THEN '{w}' || array_to_string({k}, '{sep}') END" for k, (w, sep) in H.WORDS.items()), "'(扇入' || fan_in || '/扇出' || fan_out || ')'")
HEAD = "concat_ws(chr(10), " + ", ".join(LINES) + ")"
CJK = "length(regexp_replace(head, '[^一-鿿]', '', 'g'))"
TOKENS = f"(floor({CJK} / 1.5 + (length(head) - {CJK}) / 4) + 1)::BIGINT"
FIRST = "CASE " + " ".join(f"WHEN len({k}) > 1 THEN {i}" for i, k in enumerate(CUTS)) + " ELSE 9 END"
HEADS = (
    *SEEN,
    "calls AS (SELECT * FROM whence WHERE kind = 'calls' AND confidence = 'certain')",
    *(f"{label} AS (SELECT k, list(n ORDER BY n) AS l FROM (SELECT DISTINCT {key} AS k, {name} AS n FROM {source} QUALIFY dense_rank() OVER (PARTITION BY {key} ORDER BY {name}) <= {most}) GROUP BY 1)"
      for label, key, name, source, most in (("l_out", "src", "dst_name", "calls", 12), ("l_in", "dst", "src_name", "calls", 8), ("l_head", "src_path", "dst_path", "(SELECT * FROM whence WHERE kind = 'includes' AND confidence = 'certain')", 8),
                                             ("l_pit", "l_partkey", "title", "(SELECT l_partkey, 'a known fault of supplier ' || l_suppkey || ' in deliveries of ' || l_quantity::INT AS title FROM lineitem WHERE l_discount > 0.08)", 5))),
    "bare AS (SELECT n.id, n.name, path, repeat(name || ' does what it says; ', p_size % 30) AS one_liner, coalesce(o.l, []) AS callees, coalesce(i.l, []) AS callers, coalesce(h.l, []) AS headers, [kind || '_t', kind || '_s'] AS key_types, coalesce(p.l, []) AS pitfalls, coalesce(fi.c, 0) AS fan_in, coalesce(fo.c, 0) AS fan_out"
    " FROM node n LEFT JOIN l_out o ON o.k = n.id LEFT JOIN l_in i ON i.k = n.id LEFT JOIN l_head h ON h.k = n.path LEFT JOIN l_pit p ON p.k = n.id LEFT JOIN (SELECT dst, count(*) AS c FROM calls GROUP BY 1) fi ON fi.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM calls GROUP BY 1) fo ON fo.src = n.id WHERE is_definition)",
    f"cut AS (SELECT *, {TOKENS} AS tokens, 0 AS step, false AS truncated, false AS done FROM (SELECT *, {HEAD} AS head FROM bare)"
    f" UNION ALL SELECT id, name, path, one_liner, {', '.join(CUTS)}, fan_in, fan_out, head, {TOKENS}, step, true, done FROM (SELECT *, {HEAD} AS head FROM (SELECT id, name, path, CASE WHEN f = 9 THEN substr(one_liner, 1, 40) ELSE one_liner END AS one_liner, "
    + ", ".join(f"CASE WHEN f = {i} THEN {k}[1:len({k}) - 1] ELSE {k} END AS {k}" for i, k in enumerate(CUTS)) + f", fan_in, fan_out, step + 1 AS step, f = 9 AS done FROM (SELECT *, {FIRST} AS f FROM cut WHERE tokens > 200 AND NOT done AND step < 20))))",
    "cut_last AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)",
)


@query("summary_heads", oracle("SELECT id, md5(head) AS digest, tokens, truncated, " + ", ".join(f"len({k}) AS n_{k}" for k in CUTS) + " FROM cut_last", *HEADS))
def summary_heads(s, d):
    """Head of every definition within 200 tokens: lists cut to size, then trimmed entry by entry."""
    nodes = facts.node(s, d).where("is_definition")
    purpose = F.expr("repeat(concat(name, ' does what it says; '), cast(p_size % 30 as int))")
    rows = nodes.select("id", "name", "path", purpose.alias("one_liner"), F.array(F.concat("kind", F.lit("_t")), F.concat("kind", F.lit("_s"))).alias("key_types"))
    relations = sure(s, d)
    sites = table(s, d, "lineitem").where("l_discount > 0.08")
    title = F.concat(F.lit("a known fault of supplier "), F.col("l_suppkey").cast("string"), F.lit(" in deliveries of "), F.col("l_quantity").cast("int").cast("string"))
    includes = relations.where("kind = 'includes'").select(F.col("src_path").alias("path"), F.col("dst_path").alias("header"))
    found = H.heads(rows, relations.where("kind = 'calls'"), includes, sites.select(F.col("l_partkey").alias("id"), title.alias("title")))
    return found.select("id", F.md5(F.col("head").cast("binary")).alias("digest"), "tokens", "truncated", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in CUTS))


TRIALS = (
    "trials AS (SELECT event_type AS variant, event_id AS trial, CASE user_id % 4 WHEN 0 THEN 'refusal' ELSE 'code' END AS type, event_type <> 'error' OR event_id % 50 > 0 AS reviewed, value > 20 AS correct, CASE WHEN event_id % 9 > 0 THEN (event_id % 5) / 4.0::DOUBLE END AS complete, event_id % 6 > 0 AS citation_valid, user_id % 3 > 0 AS native_planning, value > 90 AS fallback, event_id % 7 AS tool_calls, value AS latency_ms,"
    " CASE WHEN event_type <> 'view' OR event_id % 100 > 0 THEN event_id % 1000 END AS tokens, CASE WHEN event_id % 8 > 0 THEN 1 END AS input_tokens, event_id % 10 = 0 AS false_claim, CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'contradicted' END AS relation, CASE WHEN event_id % 3 > 0 THEN event_id % 5 = 0 END AS inherited, CASE WHEN event_id % 2 > 0 THEN value > 50 END AS executable FROM events)",
    "points AS (SELECT event_type AS variant, event_id AS trial, CASE event_id % 3 WHEN 0 THEN 'condition' ELSE 'fact' END AS kind, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN NULL ELSE 'met' END AS state FROM events)",
)
PCT = "round(100 * count(*) FILTER ({among} AND {yes}) / nullif(count(*) FILTER ({among}), 0), 4)"


@query("review_measures", oracle(
    "SELECT t.*, o.condition_omission_rate FROM (SELECT variant, CASE WHEN bool_and(reviewed) THEN round(100 * avg(correct::INT), 4) END AS accuracy, CASE WHEN bool_and(reviewed) THEN round(100 * avg(coalesce(complete, 0)), 4) END AS completeness, round(100 * avg(citation_valid::INT), 4) AS effective_citation_rate, "
    + PCT.format(among="type <> 'refusal'", yes="native_planning") + " AS native_planning_success_rate, round(100 * avg(fallback::INT), 4) AS fallback_rate, median(tool_calls) AS median_tool_calls, median(latency_ms) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, CASE WHEN count(tokens) = count(*) THEN median(tokens) END AS median_tokens,"
    " count(*) FILTER (input_tokens IS NULL) AS usage_missing_trials, count(*) FILTER (NOT reviewed) AS pending, count(*) AS trial_count, " + PCT.format(among="reviewed", yes="false_claim") + " AS false_assertion_rate, " + PCT.format(among="reviewed AND relation IS NOT NULL", yes="relation IN ('supported', 'not_applicable')") + " AS citation_support_safe_rate, "
    + PCT.format(among="reviewed AND inherited IS NOT NULL", yes="inherited") + " AS error_hypothesis_inheritance_rate, " + PCT.format(among="reviewed AND executable IS NOT NULL", yes="executable") + " AS verification_executable_rate FROM trials GROUP BY 1) t"
    " LEFT JOIN (SELECT variant, round(100 * avg(CASE WHEN state = 'met' THEN 0 ELSE 1 END), 4) AS condition_omission_rate FROM points p WHERE kind = 'condition' AND (variant, trial) IN (SELECT (variant, trial) FROM trials WHERE reviewed) GROUP BY 1) o ON o.variant = t.variant", *TRIALS))
def review_measures(s, d):
    """Seventeen measures of each type of event as a variant, its events as trials."""
    e, v, u = F.col("event_id"), F.col("value"), F.col("user_id")
    rows = table(s, d, "events").select(
        F.col("event_type").alias("variant"), e.alias("trial"), F.when(u % 4 == 0, "refusal").otherwise("code").alias("type"), ((F.col("event_type") != "error") | (e % 50 > 0)).alias("reviewed"), (v > 20).alias("correct"), F.when(e % 9 > 0, (e % 5) / 4.0).alias("complete"),
        (e % 6 > 0).alias("citation_valid"), (u % 3 > 0).alias("native_planning"), (v > 90).alias("fallback"), (e % 7).alias("tool_calls"), v.alias("latency_ms"), F.when((F.col("event_type") != "view") | (e % 100 > 0), e % 1000).alias("tokens"), F.when(e % 8 > 0, 1).alias("input_tokens"),
        (e % 10 == 0).alias("false_claim"), F.when(e % 4 == 0, "supported").when(e % 4 == 1, "not_applicable").when(e % 4 == 2, "contradicted").alias("relation"), F.when(e % 3 > 0, e % 5 == 0).alias("inherited"), F.when(e % 2 > 0, v > 50).alias("executable"))
    points = table(s, d, "events").select(F.col("event_type").alias("variant"), e.alias("trial"), F.when(e % 3 == 0, "condition").otherwise("fact").alias("kind"), F.when(e % 5 == 0, "missing").when(e % 5 > 1, "met").alias("state"))
    return V.review_measures(rows, points)
