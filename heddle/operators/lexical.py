"""Lexical search with bounds: postings in blocks, and only blocks and rows that can still reach a question's best.

Every term's postings lie in blocks of neighbouring rows, each with the greatest weight in it. The
rows that a question's rarest terms put first are scored in full; the k-th best of these scores
is a floor that none of the k best falls below. Terms whose greatest weights together stay under the floor cannot
bring a row in; blocks whose greatest weights stay under it are not opened. What is left is
scored in full. Results equal those of scoring every row, ties and all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.fixpoint import written
from heddle.operators.ranking import small, top

K1, B = 1.2, 0.75
BLOCK = 8  # neighbouring rows a block
PROBE = 8  # postings of rare terms, in multiples of k, that give the first rows of a question
SLACK = 2e-6  # scores are rounded to six places before they are compared


def weighted(matched: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, rowid, w: what a term adds to a row's score, from postings (rowid, term, tf, dl) and one row (n_docs, avgdl)."""
    often = matched.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    rows = matched.join(small(often), "term").join(F.broadcast(corpus), F.lit(True))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("term", "rowid", part.alias("w"))


def blocks(weights: DataFrame, size: int = BLOCK) -> DataFrame:
    """term, block, most (greatest weight), rows (array of rowid, w; at most `size`), written to the shared folder."""
    own = weights.groupBy("term", F.floor(F.col("rowid") / size).alias("block"))
    return written(own.agg(F.max("w").alias("most"), F.collect_list(F.struct("rowid", "w")).alias("rows")), "postings")


class Search:
    """The `keep` best rows for a batch of questions `asked` (qid, term) over `index` (see `blocks`), of those that hold `least` of the terms."""

    def __init__(self, index: DataFrame, asked: DataFrame, keep: int = 30, size: int = BLOCK, least: int = 1):
        self.index, self.keep, self.size, self.least = index, keep, size, least
        stats = index.groupBy("term").agg(F.sum(F.size("rows")).alias("n"), F.max("most").alias("most"))
        self.asked = written(asked.select("qid", "term").join(stats, "term"), "asked")

    def floors(self) -> DataFrame:
        """qid, floor: the k-th best full score among the rows that a question's rarest terms put first, less the slack; none without k rows."""
        before = F.sum("n").over(Window.partitionBy("qid").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1))
        rare = self.asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < PROBE * self.keep)
        partial = self.opened(rare.select("qid", "term")).groupBy("qid", "rowid").agg(F.sum("w").alias("w"))
        first = written(top(partial, "qid", [F.desc("w"), "rowid"], 2 * self.keep).select("qid", "rowid"), "first")
        full = self.looked_up(first, self.asked).groupBy("qid", "rowid").agg(F.sum("w").alias("w"), F.count("*").alias("hits")).where(F.col("hits") >= self.least)
        best = top(full, "qid", [F.desc("w"), "rowid"], self.keep)
        return best.where(F.col("rank") == self.keep).select("qid", (F.col("w") - SLACK).alias("floor"))

    def looked_up(self, chosen: DataFrame, terms: DataFrame) -> DataFrame:
        """qid, rowid, w of chosen (qid, rowid) for each of a question's `terms` that the row holds; only their blocks are opened."""
        asked = chosen.join(terms.select("qid", "term"), "qid").withColumn("block", F.floor(F.col("rowid") / self.size))
        open_ = self.index.join(asked.select("term", "block").distinct(), ["term", "block"], "left_semi")
        return asked.join(open_.select("term", F.inline("rows")), ["term", "rowid"]).select("qid", "rowid", "w")

    def opened(self, terms: DataFrame, on: list[str] | None = None) -> DataFrame:
        """qid, rowid, w for the postings of (qid, term), or of (qid, term, block)."""
        return terms.join(self.index, on or ["term"]).select("qid", F.inline("rows"))

    def essential(self, floors: DataFrame) -> DataFrame:
        """qid, term, essential, rest: terms in order of their greatest weights; the first ones, together under the floor, are not essential.

        `rest` is what those first ones can add at most.
        """
        run = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        rows = self.asked.join(floors, "qid", "left").withColumn("run", run)
        rows = rows.withColumn("essential", F.col("floor").isNull() | (F.col("run") >= F.col("floor")))
        rest = F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("qid"))
        return rows.select("qid", "term", "essential", "floor", rest.alias("rest"))

    def alive(self, terms: DataFrame) -> DataFrame:
        """qid, block of the blocks with an essential term whose greatest weights reach the floor."""
        met = terms.where("essential").join(self.index.select("term", "block", "most"), "term")
        most = met.groupBy("qid", "block").agg((F.sum("most") + F.max("rest")).alias("most"), F.max("floor").alias("floor"))
        return most.where("floor is null or most >= floor").select("qid", "block")

    def candidates(self) -> DataFrame:
        """qid, rowid, sum (over essential terms) of the rows that can reach the floor."""
        terms = written(self.essential(self.floors()), "terms")
        wanted = self.alive(terms).join(terms.where("essential").select("qid", "term"), "qid")
        rows = self.opened(wanted, ["term", "block"]).groupBy("qid", "rowid").agg(F.sum("w").alias("sum"))
        limits = terms.groupBy("qid").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
        return rows.join(limits, "qid").where("floor is null or sum + rest >= floor").select("qid", "rowid", "sum")

    def best(self) -> DataFrame:
        """qid, rowid, score, rank of the `keep` best rows; ties to the smaller rowid."""
        chosen = written(self.candidates(), "candidates")
        every = self.looked_up(chosen.select("qid", "rowid"), self.asked).groupBy("qid", "rowid")
        scored = every.agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("hits")).where(F.col("hits") >= self.least)
        return top(scored.select("qid", "rowid", "score"), "qid", [F.desc("score"), "rowid"], self.keep)
