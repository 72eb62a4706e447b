"""Queries of C sources and card files made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import csource as C
from heddle.operators.cards import rebuild
from heddle.operators.versions import rollup
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

FUNCTION = ("// {f}() {{ not this }}\nstatic int {f}(int x) {{\n  /* }} */ const char *s = \"}}{k}\\\"\";\n  if ({f}(x)) {{ return '{{'; }}\n  return x;\n}}", "int other_{f}(void)\n{{\n  return {f}(1);\n}}")
SOURCE = "int {f}(int);\n" + "\n".join(FUNCTION) + "\n"
MACROS = "#define A_{k}(x) ((x) + \\\n  {n})\n  #  define B_{k} \"q\"\nint define = 1; /* #define no */\n"


def filled(text, **columns):
    """A column: the text with columns in place of {names}."""
    import string

    parts = []
    for lead, name, _, _ in string.Formatter().parse(text):
        parts += [F.lit(lead)] + ([columns[name]] if name else [])
    return F.concat(*parts)


def filled_sql(text, **columns):
    import string

    parts = []
    for lead, name, _, _ in string.Formatter().parse(text):
        lead = lead.replace("'", "''").replace("\n", "' || chr(10) || '")
        parts += [f"'{lead}'"] + ([columns[name]] if name else [])
    return " || ".join(parts)


NAMES = dict(f="replace(name, ' ', '_') || id", k="kind", n="p_size")


@query("function_slices", oracle(
    f"SELECT id, replace(name, ' ', '_') || id AS name, 1 AS nth, md5({filled_sql(FUNCTION[0], **NAMES)}) AS digest FROM node UNION ALL SELECT id, 'other_' || replace(name, ' ', '_') || id, 1, md5({filled_sql(FUNCTION[1], **NAMES)}) FROM node"))
def function_slices(s, d):
    """Definitions in one source a node, among a declaration, calls, and braces in comments and literals."""
    f = F.concat(F.regexp_replace("name", " ", "_"), F.col("id").cast("string"))
    sources = facts.node(s, d).select("id", filled(SOURCE, f=f, k=F.col("kind")).alias("text"))
    return C.functions(sources, "id", "text").select("id", "name", "nth", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("macro_catalog", oracle(
    "SELECT name, count(*) AS n_children, sha1(concat_ws('|', count(*), sum(('0x' || substr(sha1(def), 1, 12))::BIGINT), sum(('0x' || substr(sha1(def), 13, 12))::BIGINT))) AS hash FROM (SELECT 'A_' || kind AS name, '#define A_' || kind || '(x) ((x) + ' || p_size || ')' AS def FROM node UNION ALL SELECT 'B_' || kind, '#define B_' || kind || ' \"q\"' FROM node) GROUP BY 1"))
def macro_catalog(s, d):
    """Macros by name over the sources of all nodes, with the fingerprint of their definitions."""
    sources = facts.node(s, d).select("id", filled(MACROS, k=F.col("kind"), n=F.col("p_size").cast("string")).alias("text"))
    return rollup(C.macros(sources, "id", "text").withColumn("hash", F.sha1(F.col("definition").cast("binary"))), "name")


CARD_FILES = (
    "file AS MATERIALIZED (SELECT CASE WHEN doc_id % 29 > 0 THEN 'k' || doc_id // 3 END AS id, CASE WHEN quality = 1 AND doc_id % 3 < 2 THEN 'cards' ELSE 'drafts' END AS folder, doc_id || '.md' AS path, ['draft', 'approved', 'stale', 'pending'][doc_id % 4 + 1] AS status, 'op' || doc_id % 50 AS op, sha256(coalesce(text, '')) AS sha, doc_id % 17 > 0 AS intact, doc_id FROM documents LEFT JOIN labels USING (doc_id))",
    "journal AS (SELECT DISTINCT op, path, sha FROM file WHERE doc_id % 50 % 3 = 0 AND doc_id % 7 > 0)",
    "judged AS (SELECT id, folder, path, CASE WHEN status IN ('approved', 'stale') AND op NOT IN (SELECT op FROM journal) THEN 'pending' ELSE status END AS status, CASE WHEN NOT intact THEN 'corrupt' WHEN id IS NULL THEN 'missing_id' WHEN folder = 'cards' AND count(*) FILTER (folder = 'cards') OVER (PARTITION BY id) > 1 THEN 'duplicate_canonical_id' WHEN status IN ('approved', 'stale') AND op IN (SELECT op FROM journal) AND (op, path, sha) NOT IN (SELECT (op, path, sha) FROM journal) THEN 'differs_from_journal' END AS fault FROM file)",
    "placed AS (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY folder, path DESC) END AS place FROM judged)",
)


@query("card_rebuild", oracle("SELECT id, folder, path, status, CASE WHEN place > 1 AND NOT (folder = 'cards' AND fault IS NOT NULL) THEN 'shadowed' WHEN fault IS NOT NULL THEN 'quarantine' ELSE 'card' END AS state, fault FROM placed", *CARD_FILES))
def card_rebuild(s, d):
    """Every document as a card file: three to an id, in two folders, some damaged, some published."""
    docs = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    text = lambda c: F.col(c).cast("string")
    n = F.col("doc_id")
    files = docs.select(
        F.when(n % 29 > 0, F.concat(F.lit("k"), F.floor(n / 3).cast("string"))).alias("id"), F.when((F.col("quality") == 1) & (n % 3 < 2), "cards").otherwise("drafts").alias("folder"),
        F.concat(text("doc_id"), F.lit(".md")).alias("path"), F.element_at(F.array(*map(F.lit, ("draft", "approved", "stale", "pending"))), (n % 4 + 1).cast("int")).alias("status"),
        F.concat(F.lit("op"), (n % 50).cast("string")).alias("op"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"), (n % 17 > 0).alias("intact"), "doc_id")
    journal = files.where("doc_id % 50 % 3 = 0 and doc_id % 7 > 0").select("op", F.lit("committed").alias("state"), "path", "sha")
    return rebuild(files.drop("doc_id"), journal)
