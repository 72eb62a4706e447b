"""Target-distribution importance resampling with Spark SQL functions only (operator 11).

Documents and target texts become bags of hashed n-grams (crc32 modulo BUCKETS). A bucket's
gain compares its share of the target with its share of the corpus, both smoothed by one, as
an integer of thousandths; a document's weight is the sum of its features' gains. Gumbel noise
from the document's id turns the largest scores into a draw without replacement.

Steps: explode the n-gram arrays, count by bucket (combined inside each task before the
shuffle), join the gain table by broadcast (never more than `buckets` rows), sum by document
(a document's features lie in one task, so a row a document is shuffled), sort all eligible
documents by range and number them: place in the partition plus the sizes of the partitions
before it. The sorted table is written once, so counts and places come from the same rows.

Defined cases: a null or wordless text has no features, weight 0, and is not eligible; a null id
counts as an empty one in the noise and sorts first among ties; each of several repeated rows
gets its own row and its own rank; an empty table gives no rows; with an empty target all gains
follow from the corpus alone; other columns are ignored. Texts count whole at any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES = (1 << 33) - 1  # monotonically_increasing_id keeps the place in the partition in 33 bits


def words(text: Column | str) -> Column:
    """Runs of ASCII letters and digits and of all that lies beyond ASCII, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, nothing else; plain ASCII takes the short way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def n_grams(found: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` consecutive words, joined by a blank."""
    def runs(n: int) -> Column:
        left = F.greatest(F.size(found) - (n - 1), F.lit(0))
        shifted = [F.slice(found, k + 1, left) for k in range(n)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), shifted) if n > 1 else found

    return runs(least) if least == most else F.concat(*(runs(n) for n in range(least, most + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(lowered(feature).cast("binary")) % buckets).cast("int")


def counted(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """bucket, s, t: how many features of all documents and of all target texts fall into each bucket that has any."""
    def features(texts: DataFrame, column: str, side: int) -> DataFrame:
        return texts.select(F.explode(n_grams(words(column), least, most)).alias("feature"), F.lit(side).alias("side"))

    both = features(docs, text_col, 0).unionByName(features(target, target_col, 1))
    return both.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum(1 - F.col("side")).alias("s"), F.sum("side").alias("t"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket with features; at most `buckets` rows. Counts are written once and then used twice."""
    rows = materialize(counted(docs, target, text_col, target_col, least, most, buckets), "buckets")
    total = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    share = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return rows.join(F.broadcast(total), F.lit(True)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, id_col: str, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """id_col, digest, n_words, n_features, weight: a row for each row of `docs`.

    Equal rows are counted as copies while features are summed, and are told apart again at the end.
    """
    rows = docs.select(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), words(text_col).alias("w"))
    rows = rows.select(id_col, "digest", F.greatest(F.size("w"), F.lit(0)).alias("n_words"), n_grams(F.col("w"), least, most).alias("features"))
    rows = rows.select(id_col, "digest", "n_words", F.posexplode_outer("features").alias("at", "feature"))
    met = rows.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(gain), "bucket", "left")
    own = met.groupBy(id_col, "digest").agg(
        F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("copies"), F.max("n_words").cast("bigint").alias("n_words"),
        F.count("feature").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    one = own.select(id_col, "digest", "n_words", F.expr("n div copies").alias("n_features"), F.expr("sum div copies").alias("weight"), "copies")
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             least: int = 1, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id_col, n_features, weight, score, rank (null where not drawn) of every document."""
    gain = gains(docs, target, text_col, target_col, least, most, buckets)
    scored = weighed(docs, gain, id_col, text_col, least, most, buckets).withColumn("score", F.col("weight") + noise(id_col, seed))
    eligible = F.col("n_words") >= least_words
    best_first = F.struct((~eligible).alias("out"), (-F.col("score")).alias("low"), F.col(id_col).alias("id"), "n_features", "digest")
    ordered = scored.orderBy(best_first).withColumn("at", F.monotonically_increasing_id())
    ranked = materialize(ordered.select(id_col, "n_features", "weight", "score", eligible.alias("eligible"), "at"), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = ranked.where("eligible").groupBy(part).agg(F.count("*").alias("n"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    placed = ranked.withColumn("part", part).join(F.broadcast(offsets), "part", "left")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(PLACES)) + 1
    drawn = F.when(F.col("eligible") & (rank * 100 <= F.col("all") * percent), rank)
    return placed.select(id_col, "n_features", "weight", "score", drawn.cast("bigint").alias("rank"))
