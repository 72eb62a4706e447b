"""Retrieval for whole batches of questions: lanes, fusion, reranking, assembly, refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import terms
from heddle.operators.ranking import small, top

K1, B, RRF = 1.2, 0.75, 60


def query_terms(questions: DataFrame, most: int = 12) -> DataFrame:
    """qid, term: the first `most` terms of a question with two characters or more, each once."""
    return questions.select("qid", F.explode(F.slice(terms("text", 2), 1, most)).alias("term")).distinct()


def bm25_scores(matched: DataFrame, corpus: DataFrame, query: DataFrame) -> DataFrame:
    """qid, rowid, hits (distinct terms), score (rounded to six places) from the postings of query terms.

    `matched` (rowid, term, tf, dl) holds only terms of the batch; `corpus` is one row.
    """
    often = matched.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    asked = query.join(often, "term").join(F.broadcast(corpus), F.lit(True)).select("qid", "term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = matched.repartition("rowid").join(small(asked), "term").groupBy("qid", "rowid")  # dealt by row before a posting meets its questions
    return scored.agg(F.count("*").alias("hits"), F.round(F.sum(part), 6).alias("score"))


def bm25(scores: DataFrame, keep: int = 30) -> DataFrame:
    """qid, rowid, score, rank of the best `keep` chunks a question; ties to the smaller rowid."""
    return top(scores.select("qid", "rowid", "score"), "qid", [F.desc("score"), "rowid"], keep)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame) -> DataFrame:
    """label, mean: the mean vector of each label, summed per dimension."""
    parts = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))


QUERY_BLOCK = 64


def vector_lane(vectors: DataFrame, queries: DataFrame, keep: int = 30) -> DataFrame:
    """qid, vec_id, score, rank by inner product of the rows of `vectors`, which are the visible ones: the exact lane.

    `queries` (qid, v) are packed into blocks of QUERY_BLOCK; every vector meets every block by an equality of block numbers, and
    keeps only what can be among a query's best `keep` of its task before anything is shuffled (WindowGroupLimit). For large tables see `vectors.InvertedFile`.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    packs = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("qid", "v")).alias("pack"))
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = copies.join(small(packs, 2_000), "block").select("vec_id", "e", F.inline("pack"))
    scored = met.select("qid", "vec_id", F.round(dot("e", "v"), 6).alias("score"))
    return top(scored, "qid", [F.desc("score"), "vec_id"], keep)


def fuse(lanes: list[tuple[DataFrame, Column | float]], keep: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of lanes (qid, rowid, rank): sum of weight / (60 + rank). A weight may be a column of its lane."""
    parts = [lane.select("qid", "rowid", ((w if isinstance(w, Column) else F.lit(w)) / (RRF + F.col("rank"))).alias("part")) for lane, w in lanes]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("qid", "rowid").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(fused, "qid", [F.desc("score"), "rowid"], keep)


def card_lane(scores: DataFrame, cards: DataFrame, least: int = 2, keep: int = 10) -> DataFrame:
    """BM25 over reviewed cards that hold at least `least` distinct query terms."""
    own = scores.where(F.col("hits") >= least).join(cards.select("rowid"), "rowid", "left_semi")
    return top(own.select("qid", "rowid", "score"), "qid", [F.desc("score"), "rowid"], keep)


def lexical_lanes(scores: DataFrame, cards: DataFrame, least: int = 2, keep: int = 30, keep_cards: int = 10) -> DataFrame:
    """lane, qid, rowid, score, rank: `bm25` as lane `text` and `card_lane` as lane `card`, from one pass over the scores."""
    own = scores.join(small(cards.select("rowid").distinct()).withColumn("reviewed", F.lit(True)), "rowid", "left")
    lanes = F.when(F.col("reviewed") & (F.col("hits") >= least), F.array(F.lit("text"), F.lit("card"))).otherwise(F.array(F.lit("text")))
    rows = own.select(F.explode(lanes).alias("lane"), "qid", "rowid", "score")
    return top(rows, ["lane", "qid"], [F.desc("score"), "rowid"], max(keep, keep_cards)).where(F.col("rank") <= F.when(F.col("lane") == "card", keep_cards).otherwise(keep))


def symbol_lane(symbols: DataFrame, names: DataFrame, query: DataFrame, actions: tuple[str, ...] = (), keep: int = 30) -> DataFrame:
    """qid, rowid, tier, rank: symbols by tier, each once at its best: the exact name, a prefix, the file, shared parts.

    `symbols` (rowid, name, file), `names` (qid, full_name, start), `query` (qid, term). Parts score 3
    for an action and 1 for others; a score of 2 with an action or three shared parts is needed.
    """
    exact = names.join(symbols, names["full_name"] == symbols["name"]).select("qid", "rowid", F.lit(1).alias("tier"), F.lit(0).alias("worth"))
    begin = symbols.withColumn("begin", F.regexp_extract("name", "^[^_]+_[^_]+_", 0)).where("begin <> ''")
    prefix = names.join(begin, names["start"] == begin["begin"]).where("name <> full_name").select("qid", "rowid", F.lit(2).alias("tier"), F.lit(0).alias("worth"))
    file = query.join(symbols, query["term"] == symbols["file"]).select("qid", "rowid", F.lit(3).alias("tier"), F.lit(0).alias("worth"))
    parts = symbols.select("rowid", F.explode(F.array_distinct(F.split("name", "_"))).alias("term")).where("length(term) >= 2")
    action = F.col("term").isin(*actions) if actions else F.lit(False)
    shared = query.join(parts, "term").groupBy("qid", "rowid").agg(
        F.sum(F.when(action, 3).otherwise(1)).alias("worth"), F.count("*").alias("n"), F.max(action.cast("int")).alias("acts"))
    part = shared.where("worth >= 2 and (acts = 1 or n >= 3)").select("qid", "rowid", F.lit(4).alias("tier"), F.col("worth").cast("int").alias("worth"))
    every = exact.unionByName(prefix).unionByName(file).unionByName(part)
    best = every.groupBy("qid", "rowid").agg(F.min(F.struct("tier", -F.col("worth"))).alias("b")).select("qid", "rowid", F.col("b.tier").alias("tier"), F.col("b.col2").alias("down"))
    return top(best, "qid", ["tier", "down", "rowid"], keep).drop("down")


def expand(fused: DataFrame, edges: DataFrame, seeds: int = 8, hops: int = 2, decay: float = 0.75, keep: int = 24) -> DataFrame:
    """qid, rowid, hop, score: what the best fused rows reach along edges in either direction.

    A node has its best seed's score times `decay` a hop; rows that are fused already stay out.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    level = fused.where(F.col("rank") <= seeds).select("qid", F.col("rowid").alias("at"), F.col("score").alias("carried"))
    reached = None
    for hop in range(1, hops + 1):
        stepped = level.join(both, level["at"] == both["src"]).groupBy("qid", F.col("dst").alias("rowid")).agg(F.max("carried").alias("carried"))
        level = stepped.select("qid", F.col("rowid").alias("at"), "carried")
        found = stepped.select("qid", "rowid", F.lit(hop).alias("hop"), F.round(F.col("carried") * decay**hop, 10).alias("score"))
        reached = found if reached is None else reached.unionByName(found)
    best = reached.groupBy("qid", "rowid").agg(F.max(F.struct("score", -F.col("hop"))).alias("b"))
    best = best.select("qid", "rowid", (-F.col("b.col2")).alias("hop"), F.col("b.score").alias("score"))
    return top(best.join(fused.select("qid", "rowid"), ["qid", "rowid"], "left_anti"), "qid", [F.desc("score"), "rowid"], keep).drop("rank")


# The weights of the ten features.
WEIGHTS = {
    "fusion": 6.0, "exact_symbol": 2.5, "prefix_symbol": -0.5, "is_definition": 1.0, "term_cover": 1.5,
    "file_match": 1.2, "evidence": 0.8, "importance": 0.6, "hop_decay": 0.3, "len_penalty": -0.4,
}


def rerank(candidates: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """qid, rowid, level, features, final, rank of candidates.

    `candidates`: qid, rowid, score, hop, level, chars, tier (of the symbol lane, or null), file_hit,
    is_definition, fan_in, hits, n_terms.
    """
    over = Window.partitionBy("qid")
    span = F.max("score").over(over) - F.min("score").over(over)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    value = {
        "fusion": (F.col("score") - F.min("score").over(over)) / F.when(span == 0, 1.0).otherwise(span),
        "exact_symbol": yes(F.col("tier") == 1), "prefix_symbol": yes(F.col("tier") == 2), "is_definition": yes(F.col("is_definition")),
        "term_cover": F.coalesce("hits", F.lit(0)) / F.col("n_terms"), "file_match": yes(F.col("file_hit")),
        "evidence": F.when(F.col("level") == "A", 1.0).when(F.col("level") == "B", 0.7).otherwise(0.3),
        "importance": F.log1p(F.coalesce("fan_in", F.lit(0))) / F.log(F.lit(20.0)), "hop_decay": 1 / (1 + F.col("hop")),
        "len_penalty": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("chars") / 4 - 600) / 1200)),
    }
    rows = candidates.select("qid", "rowid", "level", *(v.alias(k) for k, v in value.items()))
    final = sum((F.lit(w) * F.col(k) for k, w in weights.items()), F.lit(0.0))
    return top(rows.withColumn("final", F.round(final, 6)), "qid", [F.desc("final"), "rowid"])


def reserve(ranked: DataFrame, wanted: DataFrame, page: int = 10) -> DataFrame:
    """`ranked` with `rank` changed: the wanted rows (qid, rowid, turn from 1) are put at the end of the first page.

    With m wanted rows of a question, turn m takes the page's last place and turn m - 1 the one
    before; rows that are on the page already stay, unless a later turn has pushed them off.
    """
    held = ranked.join(wanted, ["qid", "rowid"], "left")
    m = F.max("turn").over(Window.partitionBy("qid"))
    place = F.lit(page) - (m - F.col("turn"))
    pushed = F.sum(F.when(F.col("turn").isNotNull() & (F.col("rank") > page), 1).otherwise(0)).over(
        Window.partitionBy("qid").orderBy(F.desc_nulls_last("turn")).rowsBetween(Window.unboundedPreceding, -1))
    moves = F.col("turn").isNotNull() & (F.col("rank") + F.coalesce(pushed, F.lit(0)) > page)
    at = F.when(moves, place - 0.5).otherwise(F.col("rank"))
    return top(held.withColumn("at", at).drop("rank"), "qid", ["at", F.coalesce("turn", F.lit(0))]).drop("at", "turn")


def tag(ranked: DataFrame) -> DataFrame:
    """Evidence tags: the level and the row's number within it, in rank order."""
    numbered = top(ranked, ["qid", "level"], ["rank"], name="number")
    return numbered.withColumn("tag", F.concat("level", F.col("number").cast("string"))).drop("number")


def decide(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, n_evidence, refused: a question without evidence of level A or B is refused."""
    good = ranked.where(F.col("level").isin("A", "B")).groupBy("qid").agg(F.count("*").alias("n"))
    found = questions.select("qid").join(good, "qid", "left")
    return found.select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_evidence"), F.col("n").isNull().alias("refused"))
