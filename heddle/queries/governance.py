"""Governance queries: visibility, gates, lifecycles, traces, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import governance as V
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

KINDS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in sorted(V.SECRETS.items())) + "], lambda x: x IS NOT NULL), ',')"


@query("visibility_gate", oracle("SELECT rowid, level, visible, CASE WHEN NOT visible THEN 'hidden' WHEN level = 'C' THEN 'unreviewed' ELSE 'shown' END AS state FROM chunk"))
def visibility_gate(s, d):
    state = F.when(~F.col("visible"), "hidden").when(F.col("level") == "C", "unreviewed").otherwise("shown")
    return facts.chunk(s, d).select("rowid", "level", "visible", state.alias("state"))


@query("approval_chain_reason", oracle(
    "SELECT l.doc_id, CASE WHEN length(d.text) = 0 THEN 'no_anchor' WHEN l.toxic = 1 THEN 'scope' WHEN l.quality = 0 THEN 'not_approved' WHEN d.n_chars <> length(d.text) THEN 'bundle_changed' ELSE 'current' END AS reason FROM labels l JOIN documents d ON d.doc_id = l.doc_id"))
def approval_chain_reason(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    reason = V.first_reason((F.length("text") > 0, "no_anchor"), (F.col("toxic") == 0, "scope"), (F.col("quality") == 1, "not_approved"), (F.col("n_chars") == F.length("text"), "bundle_changed"))
    return rows.select("doc_id", reason.alias("reason"))


@query("demote_unanchored", oracle("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"))
def demote_unanchored(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("impact_regression_hints", oracle("SELECT c.rowid, c.source FROM chunk c WHERE level = 'A' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.rowid AND l.toxic = 0)"))
def impact_regression_hints(s, d):
    anchors = table(s, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("rowid"))
    return facts.chunk(s, d).where("level = 'A'").join(anchors, "rowid", "left_semi").select("rowid", "source")


# Sessions have no header in the tables: it is made of the session's number.
HEADER = "header AS (SELECT DISTINCT conv_id AS session, CASE WHEN conv_id % 5 = 0 THEN 'private' ELSE 'public_synthetic' END AS source_type, CASE conv_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' END AS license, CASE WHEN conv_id % 7 = 0 THEN 'unversioned' ELSE substr(md5(conv_id::VARCHAR), 1, (conv_id % 3 + 6)::INT) END AS revision FROM conversations)"
SECRET = " OR ".join(f"regexp_matches(text, '{p}')" for p in V.SECRETS.values())
CHECKS = ("public_source", "public_license", "fixed_revision", "reproducible_input", "verification_signal", "message_structure", "sensitive_scan")
LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def header(s, d):
    k = F.col("conv_id")
    return table(s, d, "conversations").select(k).distinct().select(
        k.alias("session"), F.when(k % 5 == 0, "private").otherwise(V.PUBLIC_SOURCE).alias("source_type"),
        F.when(k % 4 == 0, "MIT").when(k % 4 == 1, "Apache-2.0").when(k % 4 == 2, "GPL-3.0").alias("license"),
        F.when(k % 7 == 0, "unversioned").otherwise(F.md5(k.cast("string").cast("binary")).substr(F.lit(1), (k % 3 + 6).cast("int"))).alias("revision"))


SAID = "SELECT conv_id, role, CASE turn % 7 WHEN 3 THEN text || ' 没有提供输入' WHEN 5 THEN '请复现: ' || text ELSE text END AS text FROM conversations"


@query("session_gate", oracle(
    "SELECT session, " + ", ".join(CHECKS) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in CHECKS) + "], lambda x: x IS NOT NULL), ',') AS failed, " + " AND ".join(CHECKS) + " AS eligible FROM checked",
    HEADER,
    f"turns AS ({SAID})",
    f"said AS (SELECT conv_id, bool_or(role = 'user' AND regexp_matches(text, '{V.REPRODUCIBLE}')) AND NOT bool_or(role = 'user' AND regexp_matches(text, '{V.MISSING}')) AS reproducible_input, bool_or(regexp_matches(text, '{V.VERIFIED}')) AS verification_signal, count(*) >= 2 AND bool_or(role IN {LIST(V.ROLES[1:])}) AS message_structure, NOT bool_or({SECRET}) AS sensitive_scan FROM turns GROUP BY 1)",
    f"checked AS (SELECT session, source_type = 'public_synthetic' AS public_source, coalesce(license IN {LIST(V.LICENSES)}, false) AS public_license, revision <> 'unversioned' AND length(revision) >= 7 AS fixed_revision, reproducible_input, verification_signal, message_structure, sensitive_scan FROM header JOIN said ON conv_id = session)"))
def session_gate(s, d):
    """Seven checks of every session, with a header made of its number; some turns say that an input is missing, some ask for a reproduction."""
    k = F.col("turn") % 7
    said = F.when(k == 3, F.concat("text", F.lit(" 没有提供输入"))).when(k == 5, F.concat(F.lit("请复现: "), "text")).otherwise(F.col("text"))
    return V.session_gate(header(s, d), table(s, d, "conversations").select(F.col("conv_id").alias("session"), "role", said.alias("text")))


@query("message_validation", oracle(f"SELECT conv_id, turn, CASE WHEN role NOT IN {LIST(V.ROLES)} THEN 'role' WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 6000 THEN 'too_long' WHEN {SECRET} THEN 'secret' END AS fault FROM conversations"))
def message_validation(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", V.message_fault(F.col("role"), F.col("text")).alias("fault"))


@query("secret_scan", oracle(f"SELECT doc_id, {KINDS} AS kinds FROM documents"))
def secret_scan(s, d):
    return table(s, d, "documents").select("doc_id", V.secret_kinds("text").alias("kinds"))


@query("session_list", oracle("SELECT conv_id, count(*) AS n, max(turn) AS last_turn, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END)::BIGINT AS n_user, max(CASE role WHEN 'system' THEN 1 ELSE 0 END) = 1 AS has_system FROM conversations GROUP BY 1"))
def session_list(s, d):
    is_ = lambda r: F.when(F.col("role") == r, 1).otherwise(0)
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.sum(is_("user")).alias("n_user"), (F.max(is_("system")) == 1).alias("has_system"))


@query("session_candidate", oracle("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS asked, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY 1"))
def session_candidate(s, d):
    """A session's questions and answers, each joined in turn order."""
    def joined(role):
        listed = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda x: x["text"]), " "))

    return table(s, d, "conversations").groupBy("conv_id").agg(joined("user").alias("asked"), joined("assistant").alias("answered"))


@query("session_dedup", oracle("SELECT sha1(text) AS content_hash, min(conv_id) AS conv_id, count(*) AS n FROM conversations GROUP BY 1"))
def session_dedup(s, d):
    return table(s, d, "conversations").groupBy(F.sha1(F.col("text").cast("binary")).alias("content_hash")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))


@query("leak_check", oracle("SELECT c.conv_id, c.turn, count(*) AS n_docs FROM conversations c JOIN documents d ON d.text = c.text GROUP BY 1, 2"))
def leak_check(s, d):
    """Turns that are some document's whole text; hashes meet first."""
    turns = table(s, d, "conversations").select("conv_id", "turn", F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    docs = table(s, d, "documents").select(F.xxhash64("text").alias("h"), "text")
    return turns.join(docs, "h").where("t = text").groupBy("conv_id", "turn").agg(F.count("*").alias("n_docs"))


@query("card_latest_state", oracle("SELECT run, last_ordinal, state FROM (SELECT run, ordinal AS last_ordinal, tool AS state, row_number() OVER (PARTITION BY run ORDER BY ordinal DESC) AS r FROM run_event) WHERE r = 1"))
def card_latest_state(s, d):
    last = V.latest(facts.run_event(s, d).select("run", "ordinal", "tool"), "run", ["ordinal"])
    return last.select("run", F.col("ordinal").alias("last_ordinal"), F.col("tool").alias("state"))


@query("bundle_hash", oracle(f"SELECT source, count(*) AS n, {facts.rollup_sql('doc_id', 'sha1(text)')} AS bundle FROM documents GROUP BY 1"))
def bundle_hash(s, d):
    return V.bundle_hash(table(s, d, "documents"), "source", "doc_id", "text")


@query("content_objects", oracle("SELECT sha256(text) AS object, count(*) AS n_uses, min(doc_id) AS first_id FROM documents GROUP BY 1"))
def content_objects(s, d):
    return table(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("object")).agg(F.count("*").alias("n_uses"), F.min("doc_id").alias("first_id"))


@query("run_trace_legality", oracle(
    "SELECT run, count(*) AS n_calls, count(*) > 60 AS over_cap, sum(CASE WHEN early THEN 1 ELSE 0 END)::BIGINT AS n_early FROM (SELECT run, ordinal, (tool = 'purchase' AND coalesce(max(CASE tool WHEN 'view' THEN 1 ELSE 0 END) OVER w, 0) = 0) OR (tool = 'click' AND coalesce(max(CASE tool WHEN 'signup' THEN 1 ELSE 0 END) OVER w, 0) = 0) AS early FROM run_event WINDOW w AS (PARTITION BY run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1"))
def run_trace_legality(s, d):
    return V.trace_legality(facts.run_event(s, d), 60, {"purchase": "view", "click": "signup"})


@query("feedback_latest", oracle("SELECT event_type, max(ts) AS last_ts, count(DISTINCT user_id) AS n_runs FROM events GROUP BY 1"))
def feedback_latest(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("n_runs"))


@query("cap_audit", oracle("SELECT run, ordinal, round(total, 4) AS total FROM (SELECT run, ordinal, sum(value) OVER (PARTITION BY run ORDER BY ordinal) AS total FROM run_event) WHERE total > 500"))
def cap_audit(s, d):
    """The calls of a run made beyond its cap of 500."""
    from pyspark.sql import Window

    total = F.sum("value").over(Window.partitionBy("run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return facts.run_event(s, d).withColumn("total", total).where("total > 500").select("run", "ordinal", F.round("total", 4).alias("total"))


@query("events_tumbling", oracle("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"))
def events_tumbling(s, d):
    """Five-minute windows; streaming.events runs the same aggregate on a stream."""
    from heddle.streaming.events import tumbling

    return tumbling(table(s, d, "events"))
