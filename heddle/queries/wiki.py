"""Queries of pages made of documents: sections and reads of Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import markdown as M
from heddle.operators import wiki as W
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.queries.pages import SEEN, sure
from heddle.registry import query
from heddle.sources.tables import table


def pages(s, d):
    """doc_id, md: every document as Markdown: lines become headings, entries, fences and paragraphs by their number."""
    def shaped(line, i):
        return (F.when(i % 23 == 0, F.concat(F.lit("## "), F.substring(line, 1, 40))).when(i % 23 == 11, F.concat(F.lit("### "), F.substring(line, 1, 40)))
                .when(i % 19 == 7, F.concat(F.lit("```\n## "), line, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("- "), line)).otherwise(F.concat(line, F.lit("\n"))))

    lines = F.split("text", "\n")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(lines, shaped), "\n").alias("md"))


@query("markdown_outline")
def markdown_outline(s, d):
    """Every page's readable sections, their reads and sizes."""
    return M.outline(M.read_pages(pages(s, d), "doc_id", "md", 300), "doc_id")


@query("markdown_pages")
def markdown_pages(s, d):
    """Every read of every section within 300 tokens, with its offsets; texts as digests."""
    reads = M.page_texts(M.read_pages(pages(s, d), "doc_id", "md", 300), "doc_id")
    return reads.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


NUMBER = "substr(split_part(path, '/', 1), 7)::INT"
INTEGRITY = (
    *SEEN,
    f"file AS MATERIALIZED (SELECT DISTINCT path, split_part(path, '/', 1) AS module, {NUMBER} AS n, split_part(path, '/', 2) AS kind FROM node)",
    "calls AS (SELECT * FROM whence WHERE kind = 'calls' AND confidence = 'certain' AND src_path <> dst_path)",
    "best AS MATERIALIZED (SELECT module, a, b, c, row_number() OVER (PARTITION BY module ORDER BY c DESC, a, b) AS rank FROM (SELECT split_part(src_path, '/', 1) AS module, src_path AS a, dst_path AS b, count(*) AS c FROM calls GROUP BY ALL) QUALIFY rank <= 20)",
    "gone AS (SELECT path FROM file WHERE n % 7 = 0 AND kind = 'PROMO')",
    "fid AS (SELECT 'files/' || replace(path, '/', '__') AS id, * FROM file)",
    "wrong AS (SELECT *, '- `' || a || '` → `' || b || '`（' AS line FROM best WHERE rank = 1 AND substr(module, 7)::INT % 4 = 0 AND module <> 'Brand#3')",
)


@query("wiki_integrity", oracle(
    "SELECT 'missing_page' AS rule, id AS page, path AS detail FROM fid WHERE path IN (SELECT path FROM gone) UNION ALL SELECT DISTINCT 'missing_page', 'modules/' || module, module FROM file WHERE n = 3"
    " UNION ALL SELECT 'missing_source', id, 'node:-1' FROM fid WHERE n % 5 = 0 AND kind = 'ECONOMY'"
    " UNION ALL SELECT 'missing_source', 'modules/' || module, 'wiki:' || id FROM fid WHERE path IN (SELECT path FROM gone) AND n <> 3 AND NOT (n = 6 AND path = (SELECT min(path) FROM file WHERE n = 6))"
    " UNION ALL SELECT 'mechanism_missing', NULL, id::VARCHAR FROM node WHERE is_definition AND (p_size = 9 OR path IN (SELECT path FROM gone))"
    " UNION ALL SELECT 'mechanism_repeated', NULL, id::VARCHAR FROM node WHERE is_definition AND p_size = 11 AND path NOT IN (SELECT path FROM gone)"
    " UNION ALL SELECT 'module_calls', 'modules/' || module, line || c || ' 条确定调用）' FROM wrong UNION ALL SELECT 'module_calls', 'modules/' || module, line || (c + 1) || ' 条确定调用）' FROM wrong"
    " UNION ALL SELECT 'module_sources', 'modules/' || module, 'wiki:' || id FROM fid WHERE n = 6 AND path = (SELECT min(path) FROM file WHERE n = 6)", *INTEGRITY))
def wiki_integrity(s, d):
    """Pages of all files and modules against the facts; some pages are missing, some say something else, some sources and mechanisms are wrong."""
    nodes = facts.node(s, d)
    files = nodes.select("path", F.split("path", "/")[0].alias("module")).distinct()
    number = F.regexp_extract("module", "([0-9]+)$", 1).cast("int")
    anchor = F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 16)
    defined = nodes.where("is_definition").select("path", "id", "name", anchor.alias("anchor"), "p_size")
    shown = defined.where("p_size <> 9")
    calls = sure(s, d).where("kind = 'calls'")
    own = W.file_pages(files, shown.unionByName(shown.where("p_size = 11")))
    kind = F.regexp_extract("id", "__(.*)$", 1)
    at = F.regexp_extract("id", "Brand#([0-9]+)", 1).cast("int")
    own = own.where(~((at % 7 == 0) & (kind == "PROMO"))).withColumn("sources", F.when((at % 5 == 0) & (kind == "ECONOMY"), F.array_append("sources", F.lit("node:-1"))).otherwise(F.array_distinct("sources")))
    modules = W.module_pages(files, calls).where(at != 3)
    first = F.concat(F.lit("wiki:"), W.page_id("files", F.lit("")))
    least = files.where(number == 6).agg(F.min("path").alias("p")).select(F.concat(F.lit("wiki:"), W.page_id("files", "p")).alias("cut"))
    modules = modules.crossJoin(F.broadcast(least)).withColumn("sources", F.when(at == 6, F.array_remove("sources", F.coalesce("cut", first))).otherwise(F.col("sources"))).drop("cut")
    line = F.regexp_extract("md", r"（(\d+) 条", 1)
    more = F.regexp_replace("md", r"(?s)^(.*?（)\d+( 条.*)$", "$1@$2")
    modules = modules.withColumn("md", F.when((at % 4 == 0) & (line != ""), F.replace(more, F.lit("@"), (line.try_cast("int") + 1).cast("string"))).otherwise(F.col("md")))
    return W.integrity(own.unionByName(modules), files, nodes, defined.select("id", "anchor"), calls)
