"""Cards rebuilt from their Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.ranking import top

PUBLISHED = ("approved", "stale", "superseded")
LISTS = {
    "anchors": "array<struct<usr: string, path: string, line_start: int, line_end: int, relation: string, active: int>>",
    "qas": "array<struct<question: string, expected_points: string, status: string, reviewer: string>>",
    "reviews": "array<struct<action: string, reviewer: string, note: string>>",
}


def rebuild(files: DataFrame, journal: DataFrame) -> DataFrame:
    """id, folder, path, status, state, fault: what becomes of every card file.

    `files` (folder: drafts or cards, path, id, status, op, sha, intact); `journal` (op, state, path, sha: what a publication wrote).
    * A canonical file (cards) wins over drafts of its id, of several drafts the last path; the others are `shadowed`.
    * A published status holds only with a committed publication that wrote this very file: without one the card is `pending` again,
      with one that wrote something else it goes to quarantine, as do files that are not intact, have no id, or share a canonical id.
    A file in quarantine doesn't stop the others, and nothing stands in for it: a draft whose canonical file is in quarantine stays shadowed.
    """
    committed = journal.where("state = 'committed'").select("op", "path", "sha").distinct()
    ops = committed.select("op").distinct().withColumn("known", F.lit(True))
    rows = files.join(ops, "op", "left").join(committed.withColumn("same", F.lit(True)), ["op", "path", "sha"], "left")
    published = F.col("status").isin(*PUBLISHED)
    per_id = files.where("folder = 'cards' and id is not null").groupBy("id").agg(F.count("*").alias("canonical"))
    rows = rows.join(per_id, "id", "left")
    fault = (F.when(~F.col("intact"), "corrupt").when(F.col("id").isNull(), "missing_id")
             .when((F.col("folder") == "cards") & (F.col("canonical") > 1), "duplicate_canonical_id")
             .when(published & F.col("known") & F.col("same").isNull(), "differs_from_journal"))
    status = F.when(published & F.col("known").isNull(), "pending").otherwise(F.col("status"))
    judged = rows.select("id", "folder", "path", status.alias("status"), fault.alias("fault"))
    named = judged.where("id is not null")
    order = [(F.col("folder") != "cards").cast("int"), F.desc("path")]
    placed = top(named, "id", order, name="place").unionByName(judged.where("id is null").withColumn("place", F.lit(1).cast("bigint")))
    canonical = (F.col("folder") == "cards") & F.col("fault").isNotNull()
    state = F.when((F.col("place") > 1) & ~canonical, "shadowed").when(F.col("fault").isNotNull(), "quarantine").otherwise("card")
    return placed.select("id", "folder", "path", "status", state.alias("state"), "fault")


def listed(cards: DataFrame, name: str) -> DataFrame:
    """id and the fields of a card's anchors, questions or reviews, from the JSON text that its front matter (`meta`) holds."""
    return cards.select("id", F.inline(F.from_json(F.col("meta")[name], LISTS[name])))


def links(anchors: DataFrame, definitions: DataFrame) -> DataFrame:
    """id, node, relation, confidence: active anchors whose definition (usr, node) is there."""
    live = anchors.where(F.coalesce("active", F.lit(1)) == 1)
    return live.join(definitions.select("usr", "node"), "usr").select("id", "node", F.coalesce("relation", F.lit("explains")).alias("relation"), F.lit("certain").alias("confidence")).distinct()


def read_cards(spark, root: str) -> DataFrame:
    """folder, path, id, status, op, sha, intact, meta of the Markdown files under root/drafts and root/cards."""
    from heddle.sources.files import markdown_cards

    parts = []
    for folder in ("drafts", "cards"):
        rows = markdown_cards(spark, f"{root}/{folder}/*.md")
        m = lambda k: F.col("meta")[k]
        parts.append(rows.select(F.lit(folder).alias("folder"), F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), m("id").alias("id"), m("status").alias("status"), m("publication_op_id").alias("op"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "intact", "meta"))
    return parts[0].unionByName(parts[1])
