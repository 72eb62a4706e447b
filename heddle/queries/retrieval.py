"""Retrieval queries: routing, lanes, fusion, reranking, assembly, decisions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.text import terms, tokens_by_bytes, tokens_by_script
from heddle.operators import evaluation as V_
from heddle.operators import evidence as E
from heddle.operators import graph as G
from heddle.operators import ranking as K
from heddle.operators import retrieval as R
from heddle.operators import vectors as V
from heddle.operators.fixpoint import written
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

SYMBOL = "[a-z]+_[a-z]+|[a-z][A-Z]|::"
PAGE, CODE_SLOTS, CARD_RANK = 10, 2, 3
LANES = (
    "scores AS MATERIALIZED (SELECT b.qid, b.rowid, b.score, h.hits FROM bm25_all b JOIN (SELECT q.qid, p.rowid, count(*) AS hits FROM qterm q JOIN posting p ON p.term = q.term GROUP BY 1, 2) h ON h.qid = b.qid AND h.rowid = b.rowid)",
    "card AS (SELECT * FROM (SELECT s.qid, s.rowid, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.rowid) AS rank FROM scores s JOIN chunk c ON c.rowid = s.rowid AND c.level = 'A' WHERE s.hits >= 2) WHERE rank <= 10)",
    "part AS (SELECT rowid, unnest(list_distinct(string_split(name, '_'))) AS term FROM symbol)",
    "tiers AS (SELECT qid, rowid, 1 AS tier, 0 AS worth FROM qname JOIN symbol ON name = full_name UNION ALL SELECT qid, rowid, 2, 0 FROM qname JOIN symbol ON regexp_extract(name, '^[^_]+_[^_]+_') = start AND name <> full_name UNION ALL SELECT qid, rowid, 3, 0 FROM qterm JOIN symbol ON term = file UNION ALL SELECT qid, rowid, 4, count(*) FROM qterm JOIN part USING (term) WHERE length(term) >= 2 GROUP BY 1, 2 HAVING count(*) >= 3)",
    "symbols AS MATERIALIZED (SELECT qid, rowid, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, worth DESC, rowid) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, rowid ORDER BY tier, worth DESC) AS r FROM tiers) WHERE r = 1 QUALIFY rank <= 30)",
    "vtext AS (SELECT 'c' AS side, rowid AS id, lower(text) AS low FROM chunk WHERE visible UNION ALL SELECT 'q', qid, lower(text) FROM question)",
    "vhead AS (SELECT side, id, regexp_replace(substr(low, 1, 1800), '\\s+', ' ', 'g') AS h FROM vtext)",
    "vfeature AS (SELECT side, id, unnest(list_transform(regexp_extract_all(low, '[a-z_][a-z0-9_]{1,}|[一-鿿]{1,4}'), lambda x: 't:' || x)) AS f FROM vtext UNION ALL SELECT side, id, unnest(list_transform(range(1, length(h) - n + 2), lambda i: 'c:' || substr(h, i, n))) FROM vhead, (VALUES (3), (4), (5)) AS g(n))",
    "vcode AS (SELECT f, ('0x' || substr(md5(f), 1, 15))::BIGINT AS x FROM (SELECT DISTINCT f FROM vfeature))",
    "vpart AS MATERIALIZED (SELECT side, id, x % 384 AS k, sum(CASE WHEN x % 2 = 1 THEN -1 ELSE 1 END)::BIGINT AS v FROM vfeature JOIN vcode USING (f) GROUP BY 1, 2, 3)",
    "vnorm AS (SELECT side, id, sum(v * v)::BIGINT AS n FROM vpart GROUP BY 1, 2)",
    "vall AS (SELECT q.id AS qid, c.id AS rowid, sum(q.v * c.v)::BIGINT AS dot FROM vpart q JOIN vpart c ON q.side = 'q' AND c.side = 'c' AND c.k = q.k GROUP BY 1, 2)",
    "vdot AS (SELECT q.id AS qid, c.id AS rowid, q.n * c.n AS nn FROM vnorm q JOIN vnorm c ON q.side = 'q' AND c.side = 'c' AND q.n > 0 AND c.n > 0)",
    "vbest AS MATERIALIZED (SELECT qid, rowid, round(coalesce(dot, 0) / sqrt(nn), 6) AS score FROM vdot LEFT JOIN vall USING (qid, rowid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) <= 30)",
    "vector AS (SELECT qid, rowid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM vbest WHERE qid IN (SELECT qid FROM bm25 UNION SELECT qid FROM symbols))",
)
FUSED = (
    *LANES,
    f"fused0 AS (SELECT qid, rowid, round(sum(part), 6) AS score FROM (SELECT qid, rowid, 1.0::DOUBLE / (60 + rank) AS part FROM bm25 UNION ALL SELECT qid, rowid, 1.0::DOUBLE / (60 + rank) FROM card UNION ALL SELECT qid, rowid, 0.35::DOUBLE / (60 + rank) FROM vector UNION ALL SELECT s.qid, s.rowid, CASE WHEN regexp_matches(q.text, '{SYMBOL}') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + s.rank) FROM symbols s JOIN question q ON q.qid = s.qid) GROUP BY 1, 2)",
    "fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) AS rank FROM fused0)",
)
HEADS = (
    "around AS MATERIALIZED (SELECT src, dst FROM links UNION SELECT dst, src FROM links)",
    "hop1 AS MATERIALIZED (SELECT f.qid, b.dst AS rowid, max(f.score) AS carried FROM fused f JOIN around b ON b.src = f.rowid WHERE f.rank <= 8 GROUP BY 1, 2)",
    "hop2 AS (SELECT h.qid, b.dst AS rowid, max(h.carried) AS carried FROM hop1 h JOIN around b ON b.src = h.rowid GROUP BY 1, 2)",
    "heads AS MATERIALIZED (SELECT qid, rowid, hop, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, rowid ORDER BY score DESC, hop) AS r FROM (SELECT qid, rowid, 1 AS hop, round(carried * 0.75, 10) AS score FROM hop1 UNION ALL SELECT qid, rowid, 2, round(carried * 0.5625, 10) FROM hop2)) h WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = h.qid AND f.rowid = h.rowid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rowid) <= 24)",
)
RANKED = (
    *FUSED, *HEADS,
    "pool AS (SELECT qid, rowid, score, 0 AS hop FROM fused UNION ALL SELECT qid, rowid, score, hop FROM heads)",
    "wanted AS (SELECT qid, count(*) AS n_terms FROM qterm GROUP BY 1)",
    "fan AS (SELECT dst AS rowid, count(*) AS fan_in FROM links GROUP BY 1)",
    "features AS MATERIALIZED (SELECT p.qid, p.rowid, c.level, (p.score - min(p.score) OVER w) / CASE WHEN max(p.score) OVER w = min(p.score) OVER w THEN 1.0 ELSE max(p.score) OVER w - min(p.score) OVER w END AS fusion, "
    "CASE WHEN s.tier = 1 THEN 1.0 ELSE 0.0 END AS exact_symbol, CASE WHEN s.tier = 2 THEN 1.0 ELSE 0.0 END AS prefix_symbol, CASE WHEN n.is_definition THEN 1.0 ELSE 0.0 END AS is_definition, coalesce(h.hits, 0) / t.n_terms AS term_cover, "
    "CASE WHEN EXISTS (SELECT 1 FROM qterm q WHERE q.qid = p.qid AND q.term = lower(c.source)) THEN 1.0 ELSE 0.0 END AS file_match, CASE c.level WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.3 END AS evidence, "
    "ln(1 + coalesce(f.fan_in, 0)) / ln(20.0) AS importance, 1.0 / (1 + p.hop) AS hop_decay, greatest(0.0, least(1.0, (length(c.text) / 4 - 600) / 1200)) AS len_penalty "
    "FROM pool p JOIN chunk c ON c.rowid = p.rowid JOIN wanted t ON t.qid = p.qid LEFT JOIN symbols s ON s.qid = p.qid AND s.rowid = p.rowid LEFT JOIN node n ON n.id = p.rowid LEFT JOIN fan f ON f.rowid = p.rowid LEFT JOIN scores h ON h.qid = p.qid AND h.rowid = p.rowid WINDOW w AS (PARTITION BY p.qid))",
    "reranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rowid) AS rank FROM (SELECT *, round(0.0 + " + " + ".join(f"({w}::DOUBLE) * {k}" for k, w in R.WEIGHTS.items()) + ", 6) AS final FROM features))",
)
# A slot moves a row to the page's end: of two wanted rows the second stands last, the first before it.
FINAL = (
    *RANKED,
    "code AS (SELECT r.qid, r.rowid, r.rank, row_number() OVER (PARTITION BY r.qid ORDER BY b.rank) AS turn FROM reranked r JOIN bm25 b ON b.qid = r.qid AND b.rowid = r.rowid WHERE r.level = 'A' AND EXISTS (SELECT 1 FROM part p JOIN qterm q ON q.term = p.term WHERE p.rowid = r.rowid AND q.qid = r.qid AND length(p.term) >= 2) QUALIFY turn <= 2)",
    "counted AS (SELECT c.*, max(turn) OVER (PARTITION BY qid) AS m, coalesce((SELECT count(*) FROM code o WHERE o.qid = c.qid AND o.turn > c.turn AND o.rank > 10), 0) AS pushed FROM code c)",
    "coded AS (SELECT r.* EXCLUDE rank, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN c.turn IS NOT NULL AND c.rank + c.pushed > 10 THEN 10 - (c.m - c.turn) - 0.5 ELSE r.rank END, coalesce(c.turn, 0)) AS rank FROM reranked r LEFT JOIN counted c ON c.qid = r.qid AND c.rowid = r.rowid)",
    "best AS (SELECT qid, rowid FROM card WHERE rank <= 3 AND (qid, rowid) IN (SELECT (qid, rowid) FROM coded) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1)",
    "final AS MATERIALIZED (SELECT r.* EXCLUDE rank, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN b.rowid IS NOT NULL AND r.rank > 10 THEN 9.5 ELSE r.rank END, CASE WHEN b.rowid IS NULL THEN 0 ELSE 1 END) AS rank FROM coded r LEFT JOIN best b ON b.qid = r.qid AND b.rowid = r.rowid)",
)
NONSENSE = "asked AS (SELECT qid FROM question UNION ALL SELECT -1)"


class Batch:
    """The lanes of all questions. What several lanes read is computed once and written to the shared folder; nothing stays in memory."""

    def __init__(self, s: SparkSession, d: str):
        self.s, self.d = s, d
        self.questions = facts.question(s, d)
        self.terms = R.query_terms(self.questions)
        self.meta = written(facts.meta(s, d), "meta")
        self.matched = written(facts.matched(s, d, self.terms), "matched")
        self.scores = R.bm25_scores(self.matched, facts.corpus(self.meta), self.terms)

    @cached_property
    def lexical(self) -> DataFrame:
        """lane, qid, rowid, score, rank: the thirty best rows of each question, and the ten best reviewed ones that hold two of its terms."""
        return written(R.lexical_lanes(self.scores, self.meta.where("level = 'A'")), "lexical")

    @property
    def text(self) -> DataFrame:
        return self.lexical.where("lane = 'text'").drop("lane")

    @property
    def card(self) -> DataFrame:
        return self.lexical.where("lane = 'card'").drop("lane")

    def symbols(self) -> DataFrame:
        t = F.slice(terms("text"), 1, facts.NAME_TERMS)
        names = self.questions.select("qid", t.alias("t")).where(F.size("t") >= facts.NAME_TERMS)
        names = names.select("qid", F.array_join("t", "_").alias("full_name"), F.concat(F.array_join(F.slice("t", 1, 2), "_"), F.lit("_")).alias("start"))
        return R.symbol_lane(self.meta.where("dl > 0").select("rowid", "name", "file"), names, self.terms)

    def vectors(self, symbols: DataFrame) -> DataFrame:
        """The visible chunks whose texts are nearest to a question's; none for a question without a lexical hit."""
        shown = facts.shown(self.s, self.d).select(F.col("rowid").alias("id"), "text")
        asked = V.hashed(self.questions, "qid", "text", V.md5)
        hit = self.text.select("qid").unionByName(symbols.select("qid")).distinct()
        index = V.InvertedFile(written(V.hashed(shown, "id", "text", V.md5), "vectors"))
        return index.nearest(asked.join(hit, "qid", "left_semi")).select("qid", F.col("id").alias("rowid"), "rank")

    def fused(self) -> tuple[DataFrame, DataFrame]:
        """(symbol lane, fused lanes)."""
        symbols = written(self.symbols(), "symbols")
        mode = self.questions.select("qid", F.when(F.col("text").rlike(SYMBOL), 1.5).otherwise(1.0).alias("w"))
        return symbols, R.fuse([(self.text, 1.0), (self.card, 1.0), (self.vectors(symbols), 0.35), (symbols.join(mode, "qid"), F.col("w"))])

    def ranked(self) -> DataFrame:
        """Fused rows and what they reach, with features, in order of the weighted sum."""
        return self.pooled()[1]

    def pooled(self) -> tuple[DataFrame, DataFrame]:
        """(fused rows and what they reach, the same with features in order of the weighted sum)."""
        symbols, fused = self.fused()
        fused = written(fused, "fused")
        links = written(facts.links(self.s, self.d, self.meta), "links")
        pool = written(fused.select("qid", "rowid", "score", F.lit(0).alias("hop")).unionByName(R.expand(fused, links).select("qid", "rowid", "score", "hop")), "pool")
        meta = self.meta.select("rowid", "level", "chars", F.col("file").alias("term"))
        fan = links.groupBy(F.col("dst").alias("rowid")).agg(F.count("*").alias("fan_in"))
        kind = facts.node(self.s, self.d).select(F.col("id").alias("rowid"), "is_definition")
        rows = pool.join(meta, "rowid").join(self.terms.groupBy("qid").agg(F.count("*").alias("n_terms")), "qid")
        rows = rows.join(symbols.select("qid", "rowid", "tier"), ["qid", "rowid"], "left").join(kind, "rowid", "left").join(fan, "rowid", "left")
        rows = rows.join(self.terms.withColumn("named", F.lit(True)), ["qid", "term"], "left").withColumn("file_hit", F.col("named").isNotNull())
        near = self.matched.select("rowid", "term").join(K.small(pool.select("rowid").distinct()), "rowid", "left_semi")
        hits = pool.select("qid", "rowid").join(self.terms, "qid").join(near, ["rowid", "term"]).groupBy("qid", "rowid").agg(F.count("*").alias("hits"))
        return pool, R.rerank(rows.join(hits, ["qid", "rowid"], "left"))

    def final(self) -> DataFrame:
        """The ranking with its reserved slots: two lexical code hits that share a name part, and one leading card."""
        ranked = written(self.ranked().select("qid", "rowid", "level", "final", "rank"), "ranked")
        code = ranked.where("level = 'A'").select("qid", "rowid").join(self.text.select("qid", "rowid", F.col("rank").alias("at")), ["qid", "rowid"])
        names = self.meta.where("dl > 0").select("rowid", "name").join(K.small(code), "rowid")
        part = names.select("qid", "rowid", "at", F.explode(F.array_distinct(F.split("name", "_"))).alias("term")).where("length(term) >= 2")
        shared = part.join(self.terms, ["qid", "term"], "left_semi").select("qid", "rowid", "at").distinct()
        code = K.top(shared, "qid", ["at"], CODE_SLOTS, name="turn").select("qid", "rowid", "turn")
        coded = R.reserve(ranked, code, PAGE)
        card = self.card.where(F.col("rank") <= CARD_RANK).select("qid", "rowid", F.col("rank").alias("at")).join(ranked.select("qid", "rowid"), ["qid", "rowid"], "left_semi")
        return R.reserve(coded, K.top(card, "qid", ["at"], 1, name="turn").select("qid", "rowid", "turn"), PAGE)


def final(s: SparkSession, d: str) -> DataFrame:
    return Batch(s, d).final()


@query("query_route", oracle(f"SELECT qid, CASE WHEN regexp_matches(text, '{SYMBOL}') THEN 'symbol' ELSE 'text' END AS route FROM question"))
def query_route(s, d):
    return facts.question(s, d).select("qid", F.when(F.col("text").rlike(SYMBOL), "symbol").otherwise("text").alias("route"))


@query("query_terms", oracle("SELECT qid, term FROM qterm"))
def query_terms(s, d):
    return R.query_terms(facts.question(s, d))


@query("bm25_top30", oracle("SELECT qid, rowid, score, rank FROM bm25"))
def bm25_top30(s, d):
    return Batch(s, d).text


@query("card_lane", oracle("SELECT qid, rowid, score, rank FROM card", *LANES))
def card_lane(s, d):
    return Batch(s, d).card


@query("symbol_lane", oracle("SELECT qid, rowid, tier, rank FROM symbols", *LANES))
def symbol_lane(s, d):
    """Four tiers of symbols, each symbol once at its best tier."""
    return Batch(s, d).symbols()


@query("vector_lane_guarded", oracle("SELECT qid, rowid, rank FROM vector", *LANES))
def vector_lane_guarded(s, d):
    batch = Batch(s, d)
    return batch.vectors(batch.symbols())


@query("rrf_fusion", oracle("SELECT qid, rowid, score, rank FROM fused", *FUSED))
def rrf_fusion(s, d):
    return Batch(s, d).fused()[1]


@query("graph_heads", oracle("SELECT qid, rowid, hop, score FROM heads", *FUSED, *HEADS))
def graph_heads(s, d):
    """What the eight best fused rows reach in two hops of either direction."""
    batch = Batch(s, d)
    return R.expand(written(batch.fused()[1], "fused"), facts.links(s, d, batch.meta))


@query("feature_rerank", oracle("SELECT qid, rowid, level, final, rank FROM reranked", *RANKED))
def feature_rerank(s, d):
    return Batch(s, d).ranked().select("qid", "rowid", "level", "final", "rank")


@query("rerank_features", oracle("SELECT qid, rowid, " + ", ".join(f"round({k}, 6) AS {k}" for k in R.WEIGHTS) + " FROM features", *RANKED))
def rerank_features(s, d):
    """The ten features of every candidate."""
    return Batch(s, d).ranked().select("qid", "rowid", *(F.round(k, 6).alias(k) for k in R.WEIGHTS))


@query("slot_reservation", oracle("SELECT qid, rowid, rank FROM final", *FINAL))
def slot_reservation(s, d):
    return final(s, d).select("qid", "rowid", "rank")


@query("evidence_tags", oracle("SELECT qid, rowid, level || row_number() OVER (PARTITION BY qid, level ORDER BY rank) AS tag FROM final", *FINAL))
def evidence_tags(s, d):
    return R.tag(final(s, d)).select("qid", "rowid", "tag")


@query("refusal_decision", oracle("SELECT a.qid, coalesce(n, 0) AS n_evidence, n IS NULL AS refused FROM asked a LEFT JOIN (SELECT qid, count(*) AS n FROM final WHERE level IN ('A', 'B') GROUP BY 1) f ON f.qid = a.qid", *FINAL, NONSENSE))
def refusal_decision(s, d):
    """All questions, and one that no text answers."""
    asked = facts.question(s, d).select("qid").unionByName(s.createDataFrame([(-1,)], "qid bigint"))
    return R.decide(asked, final(s, d))


@query("hybrid_search", oracle(
    "SELECT f.qid, f.rowid, f.rank, f.final, f.level || row_number() OVER (PARTITION BY f.qid, f.level ORDER BY f.rank) AS tag, coalesce(g.n, 0) = 0 AS refused FROM final f LEFT JOIN (SELECT qid, count(*) AS n FROM final WHERE level IN ('A', 'B') GROUP BY 1) g ON g.qid = f.qid", *FINAL))
def hybrid_search(s, d):
    """The flagship: four lanes, fusion, expansion, rerank, slots, tags and the decision for all questions."""
    good = F.max(F.col("level").isin("A", "B")).over(Window.partitionBy("qid"))
    return R.tag(final(s, d)).withColumn("refused", ~good).select("qid", "rowid", "rank", "final", "tag", "refused")


@query("heads_budget_prefix", oracle(
    "SELECT qid, rowid, used FROM (SELECT f.qid, f.rowid, sum((strlen(c.text) + 2) // 3) OVER (PARTITION BY f.qid ORDER BY f.rank)::BIGINT AS used FROM final f JOIN chunk c ON c.rowid = f.rowid) WHERE used <= 4000", *FINAL))
def heads_budget_prefix(s, d):
    sized = final(s, d).join(facts.chunk(s, d).select("rowid", tokens_by_bytes("text").alias("cost")), "rowid")
    return K.prefix_within(sized, "qid", ["rank"], "cost", 4000).select("qid", "rowid", "used")


SIZED = "sized AS (SELECT f.qid, f.rowid, f.rank, (strlen(c.text) + 2) // 3 AS cost FROM final f JOIN chunk c ON c.rowid = f.rowid)"
FIT = "fit AS (SELECT qid, rowid, rank, CASE WHEN cost <= 4000 THEN cost ELSE 0 END AS used, cost <= 4000 AS kept FROM sized WHERE rank = 1 UNION ALL SELECT s.qid, s.rowid, s.rank, CASE WHEN f.used + s.cost <= 4000 THEN f.used + s.cost ELSE f.used END, f.used + s.cost <= 4000 FROM fit f JOIN sized s ON s.qid = f.qid AND s.rank = f.rank + 1)"


@query("evidence_first_fit", oracle("SELECT qid, rowid FROM fit WHERE kept", *FINAL, SIZED, FIT))
def evidence_first_fit(s, d):
    """Chunks that fit 4000 tokens in rank order, those too large skipped."""
    sized = final(s, d).join(facts.chunk(s, d).select("rowid", tokens_by_bytes("text").alias("cost")), "rowid")
    return K.first_fit(sized, "qid", "rank", "cost", "rowid", 4000)


HEAD_CHARS = 400
CJK = "length(regexp_replace({0}, '[^一-鿿]', '', 'g'))"
TOKENS = "(floor(" + CJK + " / 1.5 + (length({0}) - " + CJK + ") / 4) + 1)::BIGINT"
ASSEMBLED = (
    *FUSED, *HEADS,
    "shown AS MATERIALIZED (SELECT rowid, level, CASE level WHEN 'A' THEN 'code' WHEN 'B' THEN 'experience' ELSE 'wiki' END AS bucket, substr(text, 1, 2400) AS t, substr(text, 1, 400) AS h FROM chunk WHERE visible)",
    f"cand AS MATERIALIZED (SELECT qid, f.rowid, bucket, level, score, rank, row_number() OVER (PARTITION BY qid, bucket ORDER BY rank) AS n, {TOKENS.format('t')} AS cost, CASE bucket WHEN 'code' THEN 3200 WHEN 'experience' THEN 1600 ELSE 1200 END AS cap FROM fused f JOIN shown s ON s.rowid = f.rowid)",
    "walk AS (SELECT qid, bucket, rowid, level, score, n, CASE WHEN cost <= cap THEN cost ELSE 0 END AS used, cost <= cap AS kept FROM cand WHERE n = 1 UNION ALL SELECT c.qid, c.bucket, c.rowid, c.level, c.score, c.n, CASE WHEN w.used + c.cost <= c.cap THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= c.cap FROM walk w JOIN cand c ON c.qid = w.qid AND c.bucket = w.bucket AND c.n = w.n + 1)",
    f"above AS (SELECT h.qid, h.rowid, h.score, row_number() OVER w AS n, sum({TOKENS.format('h')}) OVER w AS used FROM heads h JOIN shown s ON s.rowid = h.rowid WINDOW w AS (PARTITION BY h.qid ORDER BY h.score DESC, h.rowid ROWS UNBOUNDED PRECEDING))",
    "cited AS (SELECT qid, rowid, bucket, level, n, floor(score * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE AS score FROM walk WHERE kept UNION ALL SELECT qid, rowid, 'head', 'A', n, floor(score * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE FROM above WHERE used <= 2000)",
    "evidence AS MATERIALIZED (SELECT qid, rowid, bucket, level, row_number() OVER (PARTITION BY qid, bucket ORDER BY n) AS place, score, level || row_number() OVER (PARTITION BY qid, level ORDER BY score DESC, rowid::VARCHAR, bucket) AS tag FROM cited)",
)


def assembled(batch: Batch) -> tuple[DataFrame, DataFrame]:
    """(evidence of all questions, texts of chunks)."""
    fused = written(batch.fused()[1], "fused")
    heads = R.expand(fused, facts.links(batch.s, batch.d, batch.meta))
    texts = facts.chunk(batch.s, batch.d).where("visible").select("rowid", "level", F.substring("text", 1, E.SHOWN_CHARS).alias("text"), F.substring("text", 1, HEAD_CHARS).alias("head"))
    sized = texts.select("rowid", "level", tokens_by_script("text").alias("cost"), tokens_by_script("head").alias("head_cost"))
    bucket = F.when(F.col("level") == "A", "code").when(F.col("level") == "B", "experience").otherwise("wiki")
    rows = fused.join(sized, "rowid").select("qid", "rowid", F.col("rowid").alias("node"), bucket.alias("bucket"), "level", "rank", "score", "cost")
    ranked = K.top(heads.join(sized, "rowid"), "qid", [F.desc("score"), "rowid"]).select("qid", "rowid", F.col("rowid").alias("node"), "rank", "score", F.col("head_cost").alias("cost"))
    return E.assemble(rows, ranked), texts


@query("evidence_assembly", oracle("SELECT qid, rowid, bucket, level, place, score, tag FROM evidence", *ASSEMBLED))
def evidence_assembly(s, d):
    """Evidence of all questions within 8,000 tokens: source, cards and background first-fit, heads up to the first that overflows."""
    return assembled(Batch(s, d))[0]


LABEL_SQL = "CASE e.bucket " + " ".join(f"WHEN '{b}' THEN '{t}'" for b, t in E.LABELS.items()) + " END"
PLACE_SQL = "CASE e.bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(E.LABELS)) + " END"


@query("context_rendering", oracle(
    "SELECT qid, length(context) AS n_chars, md5(context) AS digest FROM (SELECT qid, string_agg(part, chr(10) || chr(10) ORDER BY o) AS context FROM bucketed GROUP BY 1)", *ASSEMBLED,
    f"bucketed AS (SELECT qid, {PLACE_SQL} AS o, '===== ' || {LABEL_SQL} || ' =====' || chr(10) || chr(10) || string_agg('[' || tag || '] ' || m.name || '  (unversioned@unversioned ' || m.path || ')' || chr(10) || CASE e.bucket WHEN 'head' THEN h ELSE t END, chr(10) || chr(10) ORDER BY place) AS part FROM evidence e JOIN shown s ON s.rowid = e.rowid JOIN symbol m ON m.rowid = e.rowid GROUP BY qid, e.bucket)"))
def context_rendering(s, d):
    """Each question's context as one text, as digest."""
    batch = Batch(s, d)
    evidence, texts = assembled(batch)
    named = batch.meta.where("dl > 0").select("rowid", F.col("name").alias("title"), F.col("path").alias("location"))
    rendered = E.render(evidence, texts.drop("level").join(named, "rowid"))
    return rendered.select("qid", F.length("context").cast("bigint").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


@query("vector_top30", oracle(
    "SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 30",
    "part AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)",
    "mean AS (SELECT label AS qid, k, avg(x) AS m FROM part GROUP BY 1, 2)",
    "scored AS (SELECT m.qid, p.vec_id, round(sum(p.x * m.m), 6) AS score FROM part p JOIN mean m ON m.k = p.k GROUP BY 1, 2)"))
def vector_top30(s, d):
    """The 30 vectors nearest to each label's mean."""
    vectors = table(s, d, "embeddings")
    return R.vector_lane(vectors, R.centroids(vectors).select(F.col("label").alias("qid"), F.col("mean").alias("v")))


@query("graph_expand_scores", oracle(
    "SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM carried QUALIFY rank <= 24",
    "seeded AS (SELECT n.kind AS qid, n.id, count(*)::DOUBLE AS score FROM certain c JOIN node n ON n.id = c.dst GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY n.kind ORDER BY count(*) DESC, n.id) <= 4)",
    "walk AS (SELECT id AS seed, dst AS id, 1 AS hop FROM seeded JOIN certain ON src = id UNION SELECT w.seed, e.dst, w.hop + 1 FROM walk w JOIN certain e ON e.src = w.id WHERE w.hop < 2)",
    "carried AS (SELECT s.qid, w.id, max(round(s.score * pow(0.75, w.hop), 6)) AS score FROM seeded s JOIN (SELECT seed, id, min(hop) AS hop FROM walk GROUP BY 1, 2) w ON w.seed = s.id GROUP BY 1, 2)"))
def graph_expand_scores(s, d):
    """From each kind's four most called nodes, two hops with decay 0.75; the best 24."""
    edges = facts.certain(s, d)
    called = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("score"))
    seeds = K.top(called.join(facts.node(s, d).select("id", F.col("kind").alias("qid")), "id"), "qid", [F.desc("score"), "id"], 4).drop("rank")
    return G.expand_scores(seeds, edges)


@query("term_statistics", oracle("SELECT term, n FROM df"))
def term_statistics(s, d):
    return facts.postings(s, d).groupBy("term").agg(F.count("*").alias("n"))


@query("token_estimates", oracle(
    "SELECT doc_id, (floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4) + 1)::BIGINT AS by_script, ((strlen(text) + 2) // 3)::BIGINT AS by_bytes FROM documents"))
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", tokens_by_script("text").alias("by_script"), tokens_by_bytes("text").alias("by_bytes"))


@query("text_windows", oracle(
    "SELECT doc_id, g.start, least(90, n - g.start) AS n_words FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n FROM documents) w, LATERAL (SELECT unnest(range(0, n, 60)) AS start) g"))
def text_windows(s, d):
    return K.text_windows(table(s, d, "documents"), "doc_id", "text")


@query("context_from_newest", oracle(
    "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum((strlen(text) + 2) // 3) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM conversations) WHERE used <= 200"))
def context_from_newest(s, d):
    """The newest turns that fit 200 tokens; older ones are left out."""
    rows = table(s, d, "conversations").select("conv_id", "turn", tokens_by_bytes("text").alias("cost"))
    return K.prefix_within(rows, "conv_id", [F.desc("turn")], "cost", 200).select("conv_id", "turn", "used")


@query("outline_pages", oracle(
    "SELECT host, page_id, page FROM (SELECT host, page_id, ((sum(strlen(html)) OVER (PARTITION BY host ORDER BY page_id) - strlen(html)) // 4000)::BIGINT AS page FROM (SELECT page_id, html, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages))"))
def outline_pages(s, d):
    """Pages of a host in order, cut into outline pages by 4000 bytes before each."""
    rows = table(s, d, "pages").select("page_id", F.octet_length("html").alias("size"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    before = F.sum("size").over(Window.partitionBy("host").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.select("host", "page_id", F.floor(before / 4000).cast("bigint").alias("page"))


@query("wiki_integrity_links", oracle(
    "SELECT page_id, count(*) AS n_links, sum(CASE WHEN p.url IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_broken FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages) l LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = l.target GROUP BY 1"))
def wiki_integrity_links(s, d):
    pages = table(s, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url"))
    known = pages.select("url").distinct().withColumn("known", F.lit(1))
    return links.join(known, "url", "left").groupBy("page_id").agg(F.count("*").alias("n_links"), F.sum(F.col("known").isNull().cast("bigint")).alias("n_broken"))


@query("required_sections", oracle("SELECT page_id, contains(html, '<h1') AS has_title, contains(html, '<a ') AS has_links, contains(html, '<p') AS has_text FROM pages"))
def required_sections(s, d):
    return table(s, d, "pages").select("page_id", F.col("html").contains("<h1").alias("has_title"), F.col("html").contains("<a ").alias("has_links"), F.col("html").contains("<p").alias("has_text"))


@query("citation_overlap", oracle(
    "SELECT a.doc_id, a.start AS citation, b.start AS anchor FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.start < b.start AND b.start < a.start + a.n",
    "w AS (SELECT doc_id, unnest(range(0, n_chars, 60)) AS start, 90 AS n FROM documents)"))
def citation_overlap(s, d):
    """Overlapping ranges of the same text: a range offers the cells it touches to the starts in them, so rows follow the overlaps."""
    w = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chars") - 1, F.lit(60).cast("bigint"))).alias("start"))
    later = w.select("doc_id", F.col("start").alias("anchor"), F.floor(F.col("start") / 90).alias("cell"))
    held = w.select("doc_id", F.col("start").alias("citation"), F.explode(F.sequence(F.floor(F.col("start") / 90), F.floor((F.col("start") + 89) / 90))).alias("cell"))
    return held.join(later, ["doc_id", "cell"]).where("citation < anchor and anchor < citation + 90").select("doc_id", "citation", "anchor")


@query("line_coverage_gap", oracle(
    "SELECT doc_id, count(*) AS n_gap FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, len(string_split(text, chr(10))) // 2 AS half FROM documents) h WHERE h.doc_id = l.doc_id AND l.ln < h.half) GROUP BY 1"))
def line_coverage_gap(s, d):
    """Lines of a text that no range covers; the ranges here are the first halves."""
    size = F.size(F.split("text", "\n"))
    lines = table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), size - 1)).alias("ln"))
    ranges = table(s, d, "documents").select("doc_id", F.floor(size / 2).alias("half"))
    return lines.join(ranges, (lines["doc_id"] == ranges["doc_id"]) & (F.col("ln") < F.col("half")), "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_gap"))


CONFIGS = ("c1_bm25", "c2_symbol", "c3_vector", "c4_body", "c5_head", "c6_rerank")
MODE = f"CASE WHEN regexp_matches(q.text, '{SYMBOL}') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + s.rank)"
ABLATION = (
    *RANKED,
    "p1 AS (SELECT qid, rowid, 1.0::DOUBLE / (60 + rank) AS part FROM bm25)", f"p2 AS (SELECT s.qid, s.rowid, {MODE} AS part FROM symbols s JOIN question q ON q.qid = s.qid)", "p3 AS (SELECT qid, rowid, 0.35::DOUBLE / (60 + rank) AS part FROM vector)",
    "fs AS (SELECT 'c1_bm25' AS config, qid, rowid, round(sum(part), 6) AS score FROM p1 GROUP BY ALL UNION ALL SELECT 'c2_symbol', qid, rowid, round(sum(part), 6) FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY ALL UNION ALL SELECT 'c3_vector', qid, rowid, round(sum(part), 6) FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY ALL)",
    f"size AS MATERIALIZED (SELECT rowid, {TOKENS.format('substr(text, 1, 2400)')} AS body, {TOKENS.format('substr(text, 1, 400)')} AS head FROM chunk WHERE visible)",
    "rows_ AS (SELECT config, qid, rowid, score, 0 AS hop FROM fs UNION ALL SELECT c, qid, rowid, score, hop FROM pool, (VALUES ('c4_body'), ('c5_head')) AS v(c) UNION ALL SELECT 'c6_rerank', r.qid, r.rowid, r.final, p.hop FROM reranked r JOIN pool p ON p.qid = r.qid AND p.rowid = r.rowid)",
    "placed AS MATERIALIZED (SELECT config, qid, r.rowid, CASE WHEN hop > 0 AND config <> 'c4_body' THEN head ELSE body END AS cost, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, r.rowid) AS rank FROM rows_ r JOIN size z ON z.rowid = r.rowid)",
    "gold AS MATERIALIZED (SELECT s.qid, s.rowid FROM scores s JOIN wanted w ON w.qid = s.qid AND s.hits >= least(w.n_terms, 9))",
    "judged AS (SELECT c.config, g.qid, CASE WHEN regexp_matches(q.text, '{SYMBOL}') THEN 'symbol' ELSE 'text_' || q.qid % 2 END AS type, coalesce(hits, 0) / least(n_gold, 10) AS r, coalesce(1 / first, 0) AS m, coalesce(spent, 0) AS c FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1) g JOIN question q ON q.qid = g.qid CROSS JOIN (SELECT DISTINCT config FROM placed) c".replace("{SYMBOL}", SYMBOL)
    + " LEFT JOIN (SELECT config, p.qid, count(*) AS hits, min(rank) AS first FROM placed p JOIN gold o ON o.qid = p.qid AND o.rowid = p.rowid WHERE rank <= 10 GROUP BY 1, 2) h ON h.config = c.config AND h.qid = g.qid LEFT JOIN (SELECT config, qid, sum(cost) AS spent FROM placed WHERE rank <= 10 GROUP BY 1, 2) z ON z.config = c.config AND z.qid = g.qid)",
    "ablated AS MATERIALIZED (SELECT type, config, count(*) AS n, round(avg(r), 6) AS recall, round(avg(m), 6) AS mrr, round(avg(c), 4) AS context FROM (SELECT * FROM judged UNION ALL SELECT config, qid, 'all', r, m, c FROM judged) GROUP BY 1, 2)",
)


def ablated(s: SparkSession, d: str) -> DataFrame:
    """Six configurations over all questions: lanes added one by one, neighbours with their bodies or heads, then the reranker.

    A question's gold are the rows that hold all of its terms (nine, if it has more).
    """
    batch = Batch(s, d)
    symbols = written(batch.symbols(), "symbols")
    text = batch.text
    mode = batch.questions.select("qid", F.when(F.col("text").rlike(SYMBOL), 1.5).otherwise(1.0).alias("w"))
    lanes = [(text, 1.0), (symbols.join(mode, "qid"), F.col("w")), (written(batch.vectors(symbols), "vector"), 0.35)]
    steps = [R.fuse(lanes[: k + 1]).select(F.lit(CONFIGS[k]).alias("config"), "qid", "rowid", "score", F.lit(0).alias("hop")) for k in range(3)]
    pool, ranked = batch.pooled()
    both = pool.select(F.explode(F.array(F.lit(CONFIGS[3]), F.lit(CONFIGS[4]))).alias("config"), "qid", "rowid", "score", "hop")
    last = ranked.join(pool.select("qid", "rowid", "hop"), ["qid", "rowid"]).select(F.lit(CONFIGS[5]).alias("config"), "qid", "rowid", F.col("final").alias("score"), "hop")
    rows = steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(both).unionByName(last)
    sizes = facts.chunk(s, d).where("visible").select("rowid", tokens_by_script(F.substring("text", 1, E.SHOWN_CHARS)).alias("body"), tokens_by_script(F.substring("text", 1, HEAD_CHARS)).alias("head"))
    short = (F.col("hop") > 0) & (F.col("config") != CONFIGS[3])
    placed = K.top(rows, ["config", "qid"], [F.desc("score"), "rowid"], 10).join(sizes, "rowid").withColumn("cost", F.when(short, F.col("head")).otherwise(F.col("body")))
    terms_ = batch.terms.groupBy("qid").agg(F.count("*").alias("n_terms"))
    gold = batch.scores.join(F.broadcast(terms_), "qid").where("hits >= least(n_terms, 9)").select("qid", "rowid")  # a row a question
    types = batch.questions.select("qid", F.when(F.col("text").rlike(SYMBOL), "symbol").otherwise(F.concat(F.lit("text_"), (F.col("qid") % 2).cast("string"))).alias("type"))
    return V_.ablation(written(placed, "placed"), written(gold, "gold"), types)


@query("ablation_matrix", oracle("SELECT type, config, n, recall, mrr, context FROM ablated", *ABLATION))
def ablation_matrix(s, d):
    """Recall at 10, reciprocal rank and context size of the six configurations, for each type of question and for all."""
    return ablated(s, d)


@query("ablation_gain", oracle("SELECT type, " + ", ".join(f"max(recall) FILTER (config = '{c}') AS {c}" for c in CONFIGS) + ", round(coalesce(max(recall) FILTER (config = 'c6_rerank'), 0) - coalesce(max(recall) FILTER (config = 'c1_bm25'), 0), 6) AS gain FROM ablated GROUP BY 1", *ABLATION))
def ablation_gain(s, d):
    """Recall of each configuration beside each other, and what the last gains over the first."""
    return V_.gains(ablated(s, d), list(CONFIGS))
