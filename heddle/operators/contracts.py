"""Resolution, module rules, change propagation, reviews and record keeping: small contracts over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Question wordings that ask for callers, callees or structure; tokens of C source.
CALLERS, CALLEES = r"(?i)who (directly )?calls|谁(直接)?调用|哪些函数(直接)?调用", r"(?i)calls? which|callees?|调用了哪些"
STRUCTURAL = r"(?i)impact|affect|call chain|callers?|callees?|影响|调用链|谁.{0,4}调用|调用了哪些"
TOKEN = r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|/\*.*?\*/|//[^\n]*|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S"""


def resolve_symbols(asked: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """q, id, rank: nodes named `q`, or whose qualified name ends in `::q` where `q` isn't qualified; definitions first, then kind, path, id.

    `nodes` (id, name, kind, path, is_definition). Both rules are equi-joins: a node offers its name and every suffix of it.
    """
    rows = nodes if kinds is None else nodes.where(F.col("kind").isin(*kinds))
    parts = F.split("name", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    offered = rows.select("*", F.posexplode(tails).alias("cut", "q")).where("cut = 0 or not contains(q, '::')")
    found = asked.select("q").distinct().join(offered, "q")
    order = Window.partitionBy("q").orderBy(F.desc("is_definition"), "kind", "path", "id")
    return found.select("q", "id", F.row_number().over(order).cast("bigint").alias("rank"))


def resolve_files(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """q, status, path: an exact path, else the one path that ends in `/q`; `ambiguous` with several, `missing` with none."""
    parts = F.split("path", "/")
    tails = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("q"))
    met = asked.select("q").distinct().join(tails, "q", "left").groupBy("q").agg(
        F.count("path").alias("n"), F.max((F.col("path") == F.col("q")).cast("int")).alias("exact"), F.min("path").alias("first"))
    status = F.when(F.col("exact") == 1, "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return met.select("q", status.alias("status"), F.when(F.col("exact") == 1, F.col("q")).when(F.col("n") == 1, F.col("first")).alias("path"))


def modules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, module: the rule with the longest prefix, `nest` adding the next folder; else the folder, `root` without one.

    `rules` (prefix, module, nest) meet paths on every folder-independent prefix length they have.
    """
    lengths = [r[0] for r in rules.select(F.length("prefix")).distinct().orderBy("length(prefix)").collect()]  # a configuration file
    own = paths.select("path").distinct()
    heads = own.select("path", F.explode(F.array(*(F.substring("path", 1, n) for n in lengths))).alias("prefix")).distinct() if lengths else own.select("path", F.lit(None).cast("string").alias("prefix"))
    best = heads.join(rules, "prefix").groupBy("path").agg(F.max_by(F.struct("prefix", "module", "nest"), F.length("prefix")).alias("r"))
    rows = own.join(best, "path", "left")
    tail = F.substring_index(F.expr("substring(path, length(r.prefix) + 1)"), "/", 1)
    ruled = F.when(F.col("r.nest") & (tail != ""), F.concat_ws("/", "r.module", tail)).otherwise(F.col("r.module"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("root")
    return rows.select("path", F.when(F.col("r").isNotNull(), ruled).otherwise(folder).alias("module"))


def agreement(votes: DataFrame, arbiter: DataFrame) -> DataFrame:
    """trial, agreed, outcome: two reviewers' votes, the arbiter's where they differ, null where none decided.

    `votes` (trial, reviewer, outcome); `arbiter` (trial, outcome).
    """
    both = votes.groupBy("trial").agg(F.countDistinct("outcome").alias("n"), F.count("outcome").alias("cast"), F.min("outcome").alias("own"))
    rows = both.join(arbiter.select("trial", F.col("outcome").alias("third")), "trial", "left")
    agreed = (F.col("n") == 1) & (F.col("cast") >= 2)
    return rows.select("trial", agreed.alias("agreed"), F.when(agreed, F.col("own")).otherwise(F.col("third")).alias("outcome"))


def point_scores(points: DataFrame, key: str) -> DataFrame:
    """key, completeness, verdict: the share of points met, and correct, partial or wrong; a contradicted point makes it wrong."""
    share = lambda s: F.avg((F.col("state") == s).cast("double"))
    rows = points.groupBy(key).agg(F.round(share("met"), 6).alias("completeness"), F.max((F.col("state") == "contradicted").cast("int")).alias("against"))
    verdict = F.when(F.col("against") == 1, "wrong").when(F.col("completeness") == 1, "correct").when(F.col("completeness") > 0, "partial").otherwise("wrong")
    return rows.select(key, "completeness", verdict.alias("verdict"))


def calibration(judged: DataFrame, least: float = 0.8) -> DataFrame:
    """state, n, recall, passes: how often a judge gives the expected state, for each state."""
    rows = judged.groupBy(F.col("expected").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("got") == F.col("expected")).cast("double")), 6).alias("recall"))
    return rows.withColumn("passes", F.col("recall") >= least)


def break_even(rows: DataFrame) -> DataFrame:
    """key, uses: how often something of `build` cost must be used until `saving` a use pays; null where it never does or the quality fell."""
    return rows.select("key", F.when((F.col("saving") > 0) & F.col("quality_kept"), F.ceil(F.col("build") / F.col("saving"))).alias("uses"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both tables, of each key the last by `order`; of equal ones the new."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*old.columns), F.struct(order, "_new"))
    return rows.groupBy(key).agg(last.alias("r")).select("r.*")


def greedy_pages(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """key, order, size, page, oversize: rows in order, a page closed before the row that would overflow it.

    A page depends on all before it, so a key's rows pass one task in order, but one at a time.
    """
    import pandas as pd

    def run(batches):
        now, page, used = None, 0, 0
        for b in batches:
            pages = []
            for k, n in zip(b[key], b[size]):
                if k != now:
                    now, page, used = k, 0, 0
                elif used and used + n > budget:
                    page, used = page + 1, 0
                used += n
                pages.append(page)
            yield pd.DataFrame({key: b[key], order: b[order], size: b[size], "page": pages, "oversize": b[size] > budget})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order, size)}
    sorted_ = rows.select(key, order, size).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", page bigint, oversize boolean")


def normal_tokens(text: Column | str) -> Column:
    """The tokens of C source without white space and comments; literals stay whole."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: ~(x.startswith("//") | x.startswith("/*")))


def compacted(text: Column | str) -> Column:
    """Source without comments, runs of white space as one blank."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def humanised(name: Column | str) -> Column:
    """An identifier as words: underscores, blanks and changes to upper case part them."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), r"[_\s]+", " "))


def key_types(text: Column | str, most: int = 6) -> Column:
    """The first names that end in _t, _s or _e."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"\b\w*(?:_t|_s|_e)\b"), F.lit(0)), 1, most)


def remapped(text: Column | str, old: str, new: str) -> Column:
    """Tags `[A1]` of one level as those of another, numbers kept."""
    return F.regexp_replace(text, rf"\[{old}(\d+)\]", rf"[{new}$1]")


def without_credentials(url: Column | str) -> Column:
    """A URL without user and password."""
    return F.regexp_replace(url, "^([a-z+]+://)[^/@]*@", "$1")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
