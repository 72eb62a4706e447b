"""Summary heads: what a definition calls, who calls it, what it includes and what is known to go wrong, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import tokens_by_script
from heddle.operators.ranking import top

# How many entries of each list a head shows, its budget, the rounds of trimming, and the words before each list.
MOST = {"callees": 12, "callers": 8, "headers": 8, "key_types": 6, "pitfalls": 5}
MOST_TOKENS, ROUNDS, SHORT = 200, 20, 40
WORDS = {"callees": ("调用: ", ", "), "callers": ("被调: ", ", "), "headers": ("头文件: ", ", "), "key_types": ("关键类型: ", ", "), "pitfalls": ("⚠ 已知问题: ", "; ")}


def first_names(rows: DataFrame, key: str, name: str, most: int, label: str) -> DataFrame:
    """key, `label`: the first `most` distinct names of each key in order; never more are gathered."""
    kept = top(rows.select(key, name).distinct(), key, [name], most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias(label))


def text(head: Column, fixed: Column, end: Column) -> Column:
    """The lines of a head: its name and purpose, one line for each list that isn't empty, its fans."""
    lines = [F.concat(fixed, head["one_liner"])]
    lines += [F.when(F.size(head[k]) > 0, F.concat(F.lit(w), F.array_join(head[k], sep))) for k, (w, sep) in WORDS.items()]
    return F.concat_ws("\n", *lines, end)


def trimmed(head: Column, fixed: Column, end: Column) -> Column:
    """The head after its trimming: while it is over the budget, the last entry of the first list that has several goes, at last the purpose is cut; ROUNDS steps at most.

    Struct of the lists, one_liner, and `truncated`.
    """
    def changed(h: Column, **new: Column) -> Column:
        names = [*WORDS, "one_liner", "truncated", "done"]
        return F.struct(*(new.get(n, h[n]).alias(n) for n in names))

    def step(h: Column, _: Column) -> Column:
        over = ~h["done"] & (tokens_by_script(text(h, fixed, end)) > MOST_TOKENS)
        cut = changed(h, one_liner=F.substring(h["one_liner"], 1, SHORT), truncated=F.lit(True), done=F.lit(True))
        for k in reversed(WORDS):
            shorter = changed(h, **{k: F.slice(h[k], 1, F.greatest(F.size(h[k]) - 1, F.lit(0)))}, truncated=F.lit(True))
            cut = F.when(F.size(h[k]) > 1, shorter).otherwise(cut)
        return F.when(over, cut).otherwise(h)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), head, step)


def heads(nodes: DataFrame, calls: DataFrame, includes: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """id, head (text), tokens, truncated and the lists of every definition.

    `nodes` (id, name, path, one_liner, key_types); `calls` (src, dst, src_name, dst_name); `includes` (path, header); `pitfalls` (id, title) from approved cards only.
    """
    lists = {
        "callees": first_names(calls.select(F.col("src").alias("id"), F.col("dst_name").alias("callees")), "id", "callees", MOST["callees"], "callees"),
        "callers": first_names(calls.select(F.col("dst").alias("id"), F.col("src_name").alias("callers")), "id", "callers", MOST["callers"], "callers"),
        "pitfalls": first_names(pitfalls.select("id", F.col("title").alias("pitfalls")), "id", "pitfalls", MOST["pitfalls"], "pitfalls"),
    }
    rows = nodes.select("id", "name", "path", F.coalesce("one_liner", F.lit("")).alias("one_liner"), F.slice("key_types", 1, MOST["key_types"]).alias("key_types"))
    for part in lists.values():
        rows = rows.join(part, "id", "left")
    rows = rows.join(first_names(includes, "path", "header", MOST["headers"], "headers"), "path", "left")
    fan_in = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    rows = rows.join(fan_in, "id", "left").join(fan_out, "id", "left").fillna(0, ["fan_in", "fan_out"])
    none = F.array().cast("array<string>")
    start = F.struct(*(F.coalesce(k, none).alias(k) for k in WORDS), "one_liner", F.lit(False).alias("truncated"), F.lit(False).alias("done"))
    fixed = F.concat(F.lit("### "), F.col("name"), F.lit(" — "))
    end = F.concat(F.lit("(扇入"), F.col("fan_in").cast("string"), F.lit("/扇出"), F.col("fan_out").cast("string"), F.lit(")"))
    cut = rows.withColumn("h", trimmed(start, fixed, end))
    shown = cut.withColumn("head", text(F.col("h"), fixed, end))
    return shown.select("id", "head", tokens_by_script("head").alias("tokens"), F.col("h.truncated").alias("truncated"), *(F.col(f"h.{k}").alias(k) for k in WORDS))
