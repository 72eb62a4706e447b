"""Pages of files and modules as Markdown, their export, and whether they still agree with the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.pages import module_calls
from heddle.operators.ranking import top

# How a page writes a call between files, and the anchor of a mechanism.
CALL_LINE = ("- `", "` → `", "`（", " 条确定调用）")
ANCHOR = r'<a id="mechanism-([0-9a-f]{16})"></a>'
CALL = r"(?m)^(- `[^`]+` → `[^`]+`（\d+ 条确定调用）)$"
LINK = r"\[[^\]]+\]\(([^)#]+\.md)\)"


def page_id(level: str, name: Column | str) -> Column:
    """The id of a file's or module's page: its name with double underscores for slashes."""
    return F.concat(F.lit(f"{level}/"), F.regexp_replace(name, "/", "__"))


def file_pages(files: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """id, level, sources, md of each file. `files` (path, module); `mechanisms` (path, id, name, anchor: 16 hexadecimal digits)."""
    piece = F.concat(F.lit('<a id="mechanism-'), "anchor", F.lit('"></a>\n### '), "name", F.lit("\n"))
    of = mechanisms.select("path", F.struct("id", piece.alias("p")).alias("m")).groupBy("path").agg(F.array_sort(F.collect_list("m")).alias("m"))  # a page holds its file
    rows = files.select("path", "module").distinct().join(of, "path", "left")
    body = F.array_join(F.transform(F.coalesce("m", F.array()), lambda x: x["p"]), "\n")
    md = F.concat(F.lit("# "), "path", F.lit("\n\n[module](../"), page_id("modules", "module"), F.lit(".md)\n\n## Mechanisms\n"), body)
    sources = F.transform(F.coalesce("m", F.array()), lambda x: F.concat(F.lit("node:"), x["id"].cast("string")))
    return rows.select(page_id("files", "path").alias("id"), F.lit("file").alias("level"), sources.alias("sources"), md.alias("md"))


def call_line(a: str, b: str, n: str) -> Column:
    return F.concat(F.lit(CALL_LINE[0]), F.col(a), F.lit(CALL_LINE[1]), F.col(b), F.lit(CALL_LINE[2]), F.col(n).cast("string"), F.lit(CALL_LINE[3]))


def module_pages(modules: DataFrame, calls: DataFrame) -> DataFrame:
    """id, level, sources, md of each module: its most frequent calls to other files. `modules` (path, module); `calls` as `pages.placed`."""
    modules = modules.select("path", "module").distinct()
    lines = module_calls(calls, modules).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank", call_line("a", "b", "n").alias("p")))).alias("l"))  # twenty at most
    held = modules.groupBy("module").agg(F.array_sort(F.collect_list(F.concat(F.lit("wiki:"), page_id("files", "path")))).alias("sources"))
    md = F.concat(F.lit("# "), "module", F.lit("\n\n## Calls\n"), F.array_join(F.transform(F.coalesce("l", F.array()), lambda x: x["p"]), "\n"))
    return held.join(lines, "module", "left").select(page_id("modules", "module").alias("id"), F.lit("module").alias("level"), "sources", md.alias("md"))


def integrity(pages: DataFrame, modules: DataFrame, nodes: DataFrame, definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """rule, page, detail: everything in which current pages and facts disagree; no rows where all is well.

    * missing_page: a file or module without a page; missing_source: a source that is no node and no page.
    * mechanism_missing, mechanism_repeated: definitions (id, anchor) without an anchor on any file page, or with several.
    * module_calls, module_sources: a module's page says something else than its calls, counted again, or its files.
    * broken_link: a link between pages that leads nowhere.
    `pages` (id, level, sources, md) are those that are ok; `modules` (path, module); `nodes` (id); `calls` as `pages.placed`.
    """
    modules = modules.select("path", "module").distinct()
    known = pages.select("id").distinct()
    error = lambda rows, rule, page, detail: rows.select(F.lit(rule).alias("rule"), F.col(page).alias("page"), F.col(detail).cast("string").alias("detail"))
    wanted = modules.select(page_id("files", "path").alias("id"), F.col("path").alias("d")).unionByName(modules.select(page_id("modules", "module").alias("id"), F.col("module").alias("d"))).distinct()
    out = [error(wanted.join(known, "id", "left_anti"), "missing_page", "id", "d")]
    held = pages.select(F.col("id").alias("page"), "level", F.explode("sources").alias("s"))
    real = nodes.select(F.concat(F.lit("node:"), F.col("id").cast("string")).alias("s")).unionByName(known.select(F.concat(F.lit("wiki:"), "id").alias("s")))
    out.append(error(held.join(real, "s", "left_anti"), "missing_source", "page", "s"))
    anchors = pages.where("level = 'file'").select(F.explode(F.regexp_extract_all("md", F.lit(ANCHOR), F.lit(1))).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n"))
    met = definitions.select(F.col("id").alias("d"), "anchor").join(anchors, "anchor", "left").withColumn("page", F.lit(None).cast("string"))
    out += [error(met.where("n is null"), "mechanism_missing", "page", "d"), error(met.where("n > 1"), "mechanism_repeated", "page", "d")]
    there = pages.where("level = 'module'")
    said = there.select(F.col("id").alias("page"), F.explode(F.regexp_extract_all("md", F.lit(CALL), F.lit(1))).alias("line")).distinct().withColumn("said", F.lit(True))
    true = module_calls(calls, modules).select(page_id("modules", "module").alias("page"), call_line("a", "b", "n").alias("line")).join(there.select(F.col("id").alias("page")), "page", "left_semi").withColumn("held", F.lit(True))
    out.append(error(said.join(true, ["page", "line"], "full").where("said is null or held is null"), "module_calls", "page", "line"))
    own = held.where("level = 'module'").select("page", "s").distinct().withColumn("said", F.lit(True))
    files = modules.select(page_id("modules", "module").alias("page"), F.concat(F.lit("wiki:"), page_id("files", "path")).alias("s")).join(there.select(F.col("id").alias("page")), "page", "left_semi").distinct().withColumn("held", F.lit(True))
    out.append(error(own.join(files, ["page", "s"], "full").where("said is null or held is null"), "module_sources", "page", "s"))
    links = pages.select(F.col("id").alias("page"), F.explode(F.regexp_extract_all("md", F.lit(LINK), F.lit(1))).alias("t"))
    target = F.when(F.col("t").startswith("../"), F.substring("t", 4, 1 << 30)).otherwise(F.concat(F.substring_index("page", "/", 1), F.lit("/"), "t"))
    links = links.withColumn("id", F.regexp_replace(target, r"\.md$", ""))
    out.append(error(links.join(known, "id", "left_anti"), "broken_link", "page", "t"))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def export(pages: DataFrame, root: str, id_col: str = "id", meta: list[str] | None = None) -> None:
    """Each page as one text file in a folder of its own (`page=<id>`), with a JSON front matter that holds `meta` and the SHA-256 of the body; an index lists them.

    Spark writes the files, so any store it knows will do; a page is one row.
    """
    front = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in [id_col, *(meta or [])]), F.sha2(F.col("md").cast("binary"), 256).alias("sha256")))
    text = F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "md")
    pages.select(F.col(id_col).alias("page"), text.alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(f"{root}/pages", lineSep="\n")
    listed = top(pages.select(F.lit(1).alias("k"), F.substring_index(id_col, "/", 1).alias("level"), F.col(id_col).alias("id")), ["level"], ["id"])
    listed.select(F.concat(F.lit("- ["), "id", F.lit("]("), "id", F.lit(".md)")).alias("value"), "level").repartition("level").sortWithinPartitions("value").write.mode("overwrite").partitionBy("level").text(f"{root}/index")
