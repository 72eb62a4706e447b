"""Where citations come from, whether they still hold, and whether an answer may use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ("path", "line_start", "line_end")


def code_provenance(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """`citations` (with node) and symbol, usr, path, line_start, line_end, definition_hash of their nodes; nulls where there is none.

    `nodes`: id, name, usr, path, line_start, line_end, definition_hash, is_definition.
    """
    of = nodes.select(F.col("id").alias("node"), F.col("name").alias("symbol"), "usr", *PLACE, "definition_hash")
    return citations.join(of, "node", "left")


def card_provenance(citations: DataFrame, cards: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """`citations` (with card) and the card's status, its last active anchor, and the place of that function now.

    A definition that moved unchanged is cited where it is; one that changed, or is gone, where it was reviewed.
    `cards` (card, status); `anchors` (card, anchor, active, usr, path, line_start, line_end, definition_hash).
    """
    fields = ("usr", *PLACE, "definition_hash")
    last = anchors.where("active").groupBy("card").agg(F.max_by(F.struct(*fields), "anchor").alias("a"))
    now = nodes.where("is_definition").select(F.col("usr").alias("n_usr"), F.col("name").alias("symbol"), *(F.col(c).alias(f"n_{c}") for c in (*PLACE, "definition_hash")))
    rows = citations.join(cards.select("card", "status"), "card", "left").join(last, "card", "left")
    rows = rows.join(now, F.col("a.usr") == F.col("n_usr"), "left")
    moved = F.col("n_definition_hash") == F.col("a.definition_hash")
    place = [F.when(moved, F.col(f"n_{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in PLACE]
    return rows.select(*citations.columns, F.coalesce("status", F.lit("missing")).alias("card_status"), "symbol", F.col("a.usr").alias("usr"), *place, F.col("a.definition_hash").alias("definition_hash"))


def valid(citations: DataFrame, nodes: DataFrame, cards: DataFrame, pages: DataFrame, repository: str, revision: str) -> DataFrame:
    """`citations` with `valid`: made from this repository and revision, not stale, and by level:

    A: the lines lie inside the definition of that name and path, whose hash is unchanged where one is given; B: the card is approved; C: the page is ok.
    `citations`: level, stale, repository, revision, usr, path, line_start, line_end, definition_hash, owner (card or page). A level of any other name never holds.
    """
    key = citations.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in citations.columns else citations
    of = nodes.where("is_definition").select("usr", "path", F.col("line_start").alias("_from"), F.col("line_end").alias("_to"), F.col("definition_hash").alias("_hash")).dropDuplicates(["usr", "path"])
    rows = key.join(of, ["usr", "path"], "left")
    rows = rows.join(cards.where("status = 'approved'").select(F.col("card").alias("owner")).distinct().withColumn("_card", F.lit(True)), "owner", "left")
    rows = rows.join(pages.where("status = 'ok'").select(F.col("page").alias("owner")).distinct().withColumn("_page", F.lit(True)), "owner", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    inside = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("_from") <= F.col("line_start")) & (F.col("line_end") <= F.col("_to"))
    same = F.col("definition_hash").isNull() | (F.col("definition_hash") == F.col("_hash"))
    level = F.when(F.col("level") == "A", yes(inside & same)).when(F.col("level") == "B", yes(F.col("_card"))).when(F.col("level") == "C", yes(F.col("_page"))).otherwise(False)
    current = ~yes(F.col("stale")) & yes(F.col("repository") == repository) & yes(F.col("revision") == revision)
    return rows.withColumn("valid", current & level).select(*citations.columns, "valid")


def complete(repository: str, revision: str) -> Column:
    """Whether a citation of level A names its source in full: repository, revision, symbol identity, path and lines."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    lines = F.coalesce((F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start")), F.lit(False))
    return F.coalesce((F.col("level") == "A") & (F.col("repository") == repository) & (F.col("revision") == revision), F.lit(False)) & filled("usr") & filled("path") & lines


def answers(said: DataFrame, citations: DataFrame) -> DataFrame:
    """answer, n_tags, citation_valid, answer_correctness: whether an answer cites, only what it was given, and only what holds.

    `said` (answer, text); `citations` (answer, tag, valid). Never more than `pending_human_review`: a human decides on correctness.
    """
    tags = said.select("answer", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([ABC]\d+)\]"), F.lit(1)))).alias("tag"))
    met = tags.join(citations.groupBy("answer", "tag").agg(F.min("valid").alias("valid")), ["answer", "tag"], "left")
    out = met.groupBy("answer").agg(F.count("tag").alias("n_tags"), F.min(F.coalesce("valid", F.lit(False))).alias("ok"))
    good = (F.col("n_tags") > 0) & F.col("ok")
    return out.select("answer", "n_tags", good.alias("citation_valid"), F.when(good, "pending_human_review").otherwise("invalid_citation").alias("answer_correctness"))


def matches(citations: DataFrame, anchors: DataFrame) -> DataFrame:
    """`anchors` (task, anchor, symbol, path, line_start or null) with `matched`: a citation of the task names the symbol and path, and the line where the anchor has one."""
    found = anchors.alias("a").join(citations.select("task", "symbol", "path", F.col("line_start").alias("_line")).alias("c"), ["task", "symbol", "path"])
    hit = found.where(F.col("line_start").isNull() | (F.col("line_start") == F.col("_line"))).select("task", "anchor").distinct().withColumn("matched", F.lit(True))
    return anchors.join(hit, ["task", "anchor"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def selected_facts(claims: DataFrame, known: DataFrame) -> DataFrame:
    """answer, valid: whether all of an answer's claims (answer, fact, payload) are confirmed facts (fact, payload) word for word."""
    held = known.select("fact", F.col("payload").alias("_known"))
    rows = claims.join(held, "fact", "left")
    return rows.groupBy("answer").agg(F.min(F.coalesce(F.col("payload") == F.col("_known"), F.lit(False))).alias("valid"))
