"""The operators applied to the input tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import ann, bpe, decontaminate, importance, langid, licenses, lines, minhash, negatives, oracles, packing, quality, repeats, toxicity
from heddle.llm.common import fold


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under 50-byte strings that an earlier document holds."""
    return repeats.repeats(read(spark, sf_dir, "documents")).drop("starts", "ends")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it holds a benchmark passage, and which items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["version"])
    return docs.join(found, same, "left").select(
        docs["doc_id"],
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its lines, and the numbers of those that go as near duplicates of a line that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = lines.removals(docs)
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("bigint")
    rows = docs.select("doc_id", n_lines.alias("n_lines"), F.xxhash64("text").alias("v"))
    found = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["v"] == gone["version"]), "left")
    return found.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.array_size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and decoded bytes of every document, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from profiles learned on the rows whose fold is not 1."""
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs, profiles).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a grammar learned on labelled rows whose fold is not 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids packed into rows of 2,048."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at Jaccard 0.85 of three-word shingles."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85).drop("version")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and scores of every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark; every document's weight, score and rank."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; every seventh vector has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a network learned on labelled rows whose fold is not 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 3) != 1)
    vectors = quality.word_vectors(docs)
    scored = quality.score(docs, vectors, quality.fit(docs, labels, vectors))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", predicted, "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_ann": op2_ann,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_licenses": op10_licenses,
    "op11_importance": op11_importance,
    "op12_negatives": op12_negatives,
    "op13_quality": op13_quality,
}

ORACLES: dict[str, str] = {"op1_repeats": oracles.REPEATS, "op9_minhash": oracles.MINHASH, "op11_importance": oracles.IMPORTANCE, "op12_negatives": oracles.NEGATIVES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
