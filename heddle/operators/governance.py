"""Review-gated visibility, session gates, lifecycles and run traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.incremental import merkle

# Patterns of secrets, roles, public licences and the size limit of a session's messages.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "key": r"\b(?:sk|rk|pk)_[A-Za-z0-9_-]{16,}\b",
    "password": r"(?i)\b(?:password|secret|token)\s*[:=]\s*\S+",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
}
ROLES = ("user", "assistant", "developer", "reviewer", "tool")
KNOWLEDGE_ROLES = ("symptom", "hypothesis", "dead_end", "evidence", "root_cause", "fix", "verification")
PUBLIC_SOURCE = "public_synthetic"
LICENSES = ("CC0-1.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0")
REPRODUCIBLE = r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b|\b[A-Za-z][A-Za-z0-9_]+\s*\(|输入|复现|调用|定义|失败|返回"
MISSING = r"(?:没有|缺少|未提供|无法提供).{0,24}(?:函数|符号|输入|复现|版本|抓包|配置)"
VERIFIED = r"(?i)验证|复现|测试|核对|检查|查看|verify|reproduc|test|check"
MOST_CHARS = 6000


def secret_kinds(text: str) -> Column:
    """The kinds of secret a text holds, in alphabetical order, comma-joined."""
    found = F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in sorted(SECRETS.items())))
    return F.array_join(F.array_compact(found), ",")


def message_fault(role: Column, content: Column, knowledge_role: Column | None = None) -> Column:
    """The first fault of a message, or null: its role, an empty or long content, an unknown knowledge role, a secret."""
    secret = F.lit(False)
    for p in SECRETS.values():
        secret = secret | content.rlike(p)
    fault = F.when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "role").when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty").when(F.length(content) > MOST_CHARS, "too_long")
    if knowledge_role is not None:
        fault = fault.when(knowledge_role.isNotNull() & ~knowledge_role.isin(*KNOWLEDGE_ROLES), "knowledge_role")
    return fault.when(secret, "secret")


def session_gate(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session, seven checks, failed (their names), eligible. An input counts only where the user doesn't say that one is missing.

    `sessions`: session, source_type, license, revision; `messages`: session, role, text. What
    can be decided for single messages is decided there, so no session's texts are gathered.
    """
    some = lambda c: F.coalesce(F.max(F.when(c, 1).otherwise(0)), F.lit(0)) == 1
    user = F.col("role") == "user"
    said = messages.groupBy("session").agg(
        (some(user & F.col("text").rlike(REPRODUCIBLE)) & ~some(user & F.col("text").rlike(MISSING))).alias("reproducible_input"), some(F.col("text").rlike(VERIFIED)).alias("verification_signal"),
        ((F.count("*") >= 2) & some(F.col("role").isin(*ROLES[1:]))).alias("message_structure"), (~some(secret_kinds("text") != "")).alias("sensitive_scan"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    revision = F.coalesce(F.col("revision"), F.lit(""))
    rows = sessions.join(said, "session", "left").select(
        "session", F.coalesce(F.col("source_type") == PUBLIC_SOURCE, F.lit(False)).alias("public_source"), F.coalesce(F.col("license").isin(*LICENSES), F.lit(False)).alias("public_license"),
        ((revision != "unversioned") & (F.length(revision) >= 7)).alias("fixed_revision"), no("reproducible_input"), no("verification_signal"), no("message_structure"), no("sensitive_scan"),
    )
    checks = rows.columns[1:]
    failed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in checks))), ",")
    return rows.withColumn("failed", failed).withColumn("eligible", F.col("failed") == "")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails, or `current`."""
    out = None
    for ok, reason in checks:
        out = F.when(~ok, reason) if out is None else out.when(~ok, reason)
    return out.otherwise("current")


def approved_current(cards: DataFrame, anchors: DataFrame, experiments: DataFrame, questions: DataFrame, reviews: DataFrame, confirmations: DataFrame, scope: str = "formal") -> DataFrame:
    """card, valid, reason: whether each card's approval still holds, and the first link of the chain that doesn't.

    * cards (card, artifact_scope, review_bundle, bundle: the hash now); anchors and experiments (card, valid, reason); a card without a row in them is `anchors_missing`, or has no experiments to hold.
    * questions (card, status, bundle, scope, reviewer_type); reviews (card, seq, action, scope, reviewer_type); confirmations (card, bundle, reviewer_type).
    In the formal scope people must have passed the questions, approved, and confirmed this very bundle.
    """
    formal = scope == "formal"
    human = (F.col("reviewer_type") == "human") if formal else F.lit(True)
    own = cards.select("card", F.coalesce("artifact_scope", F.lit("formal")).alias("scope"), "review_bundle", "bundle")
    passed = questions.where((F.col("status") == "passed") & (F.col("scope") == scope) & human).select("card", "bundle").distinct().withColumn("passed", F.lit(True))
    last = reviews.where("action = 'approve'").groupBy("card").agg(F.max_by(F.struct("scope", "reviewer_type"), "seq").alias("r"))
    sure = confirmations.where("reviewer_type = 'human'").select("card", "bundle").distinct().withColumn("sure", F.lit(True))
    rows = own.join(anchors.select("card", F.col("valid").alias("a_valid"), F.col("reason").alias("a_reason")), "card", "left")
    rows = rows.join(experiments.select("card", F.col("valid").alias("e_valid"), F.col("reason").alias("e_reason")), "card", "left")
    rows = rows.join(passed, ["card", "bundle"], "left").join(last, "card", "left").join(sure, ["card", "bundle"], "left")
    reason = F.when(F.col("a_valid").isNull(), "anchors_missing").when(~F.col("a_valid"), F.col("a_reason")).when(F.col("scope") != scope, "artifact_scope_not_visible")
    if formal:
        reason = reason.when(F.col("e_valid") == False, F.col("e_reason"))  # noqa: E712
    reason = reason.when(~F.col("review_bundle").eqNullSafe(F.col("bundle")), "review_bundle_changed").when(F.col("passed").isNull(), "qa_no_longer_valid")
    reason = reason.when(F.col("r").isNull() | ~F.col("r.scope").eqNullSafe(F.lit(scope)), "approval_scope_invalid")
    if formal:
        reason = reason.when(~F.col("r.reviewer_type").eqNullSafe(F.lit("human")), "formal_approval_requires_human").when(F.col("sure").isNull(), "formal_approval_requires_current_confirmation")
    return rows.select("card", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a replay of a log of transitions. One partial aggregate, no sort of the log."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def trace_legality(events: DataFrame, most: int, before: dict[str, str]) -> DataFrame:
    """run, n_calls, over_cap, n_early: calls beyond the cap, and calls whose prerequisite tool didn't come earlier."""
    past = Window.partitionBy("run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    early = F.lit(False)
    for tool, needed in before.items():
        seen = F.coalesce(F.max(F.when(F.col("tool") == needed, 1).otherwise(0)).over(past), F.lit(0))
        early = early | ((F.col("tool") == tool) & (seen == 0))
    rows = events.withColumn("early", early)
    return rows.groupBy("run").agg(F.count("*").alias("n_calls"), (F.count("*") > most).alias("over_cap"), F.sum(F.col("early").cast("bigint")).alias("n_early"))


def bundle_hash(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """key, n, bundle: a hash of a group's contents under their numbers; sums of hashes, so a group of any size is no list."""
    hashed = rows.select(key, order, F.sha1(F.col(content).cast("binary")).alias("hash"))
    return merkle(hashed, key, order).select(key, F.col("n_children").alias("n"), F.col("hash").alias("bundle"))
