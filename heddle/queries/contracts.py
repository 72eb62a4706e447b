"""Queries of contracts: resolution, modules, propagation, reviews, text functions, refresh records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions.text import short_id
from heddle.operators import contracts as C
from heddle.operators.incremental import merkle
from heddle.operators.ranking import numbered
from heddle.plans import facts
from heddle.plans.facts import oracle
from heddle.registry import query
from heddle.sources.tables import table

# Nodes under qualified names: the colour and the thing of a part's name, joined by `::`.
QNODE = "qnode AS (SELECT id, replace(name, ' ', '::') AS name, kind, path, is_definition FROM node)"
ASKED = "asked AS (SELECT DISTINCT name AS q FROM qnode UNION SELECT DISTINCT split_part(name, '::', 2) FROM qnode)"


def qnode(s, d):
    return facts.node(s, d).withColumn("name", F.regexp_replace("name", " ", "::"))


@query("resolve_symbol_rules", oracle("SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY is_definition DESC, kind, path, id) AS rank FROM asked JOIN qnode ON name = q OR (NOT contains(q, '::') AND ends_with(name, '::' || q)) WHERE kind IN ('ECONOMY', 'PROMO', 'STANDARD')", QNODE, ASKED))
def resolve_symbol_rules(s, d):
    """Full and bare names against nodes of three kinds."""
    nodes = qnode(s, d)
    asked = nodes.select(F.col("name").alias("q")).unionByName(nodes.select(F.element_at(F.split("name", "::"), 2).alias("q"))).where("q is not null")
    return C.resolve_symbols(asked, nodes, ("ECONOMY", "PROMO", "STANDARD"))


FILES = ("fpath AS (SELECT DISTINCT path FROM node)", "fasked AS (SELECT DISTINCT path AS q FROM node UNION SELECT DISTINCT kind FROM node UNION SELECT 'nowhere.c')")


@query("resolve_file_rules", oracle(
    "SELECT q, CASE WHEN exact = 1 THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN exact = 1 THEN q WHEN n = 1 THEN first END AS path FROM (SELECT q, count(path) AS n, max(CASE WHEN path = q THEN 1 ELSE 0 END) AS exact, min(path) AS first FROM fasked LEFT JOIN fpath ON path = q OR ends_with(path, '/' || q) GROUP BY 1)", *FILES))
def resolve_file_rules(s, d):
    """Paths, bare file names and a missing one, against the files of all nodes."""
    nodes = facts.node(s, d)
    asked = C.union([nodes.select(F.col("path").alias("q")), nodes.select(F.col("kind").alias("q")), s.createDataFrame([("nowhere.c",)], "q string")])
    return C.resolve_files(asked, nodes)


RULES = (("Brand#1", "first", False), ("Brand#12", "twelve", True), ("Brand#2/", "second", True), ("Brand#2/ECONOMY", "cheap", False))
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', {str(n).lower()})" for p, m, n in RULES) + ") AS v(prefix, module, nest))"


@query("module_rules", oracle(
    "SELECT path, CASE WHEN prefix IS NULL THEN CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE 'root' END WHEN nest AND tail <> '' THEN module || '/' || tail ELSE module END AS module FROM "
    "(SELECT *, split_part(substr(path, length(prefix) + 1), '/', 1) AS tail, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC NULLS LAST) AS r FROM (SELECT DISTINCT path FROM node) LEFT JOIN rules ON starts_with(path, prefix)) WHERE r = 1", RULE_SQL))
def module_rules(s, d):
    """Modules of paths by the longest of several overlapping prefixes."""
    return C.modules(facts.node(s, d), s.createDataFrame(list(RULES), "prefix string, module string, nest boolean"))


@query("question_intent", oracle(f"SELECT conv_id, turn, regexp_matches(text, '{C.STRUCTURAL}') AS structural, CASE WHEN regexp_matches(text, '{C.CALLERS}') THEN 'in' WHEN regexp_matches(text, '{C.CALLEES}') THEN 'out' ELSE 'both' END AS direction, CASE WHEN contains(text, '直接调用') THEN 1 ELSE 2 END AS hops FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'who calls ' WHEN 1 THEN 'what does it affect: ' WHEN 2 THEN '谁直接调用 ' ELSE '' END || text AS text FROM conversations)"))
def question_intent(s, d):
    """Intent of every turn, three of four of which get a question's beginning."""
    k = F.col("turn") % 4
    asked = F.concat(F.when(k == 0, "who calls ").when(k == 1, "what does it affect: ").when(k == 2, "谁直接调用 ").otherwise(""), F.col("text"))
    direction = F.when(asked.rlike(C.CALLERS), "in").when(asked.rlike(C.CALLEES), "out").otherwise("both")
    return table(s, d, "conversations").select("conv_id", "turn", asked.rlike(C.STRUCTURAL).alias("structural"), direction.alias("direction"), F.when(asked.contains("直接调用"), 1).otherwise(2).alias("hops"))


VOTES = (
    "votes AS (SELECT l_orderkey AS trial, l_linenumber AS reviewer, min(l_returnflag) AS outcome FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2)",
    "arbiter AS (SELECT o_orderkey AS trial, substr(o_orderpriority, 3, 1) AS outcome FROM orders WHERE o_orderstatus <> 'P')",
)


@query("arbitration", oracle("SELECT v.trial, n = 1 AND cast_ >= 2 AS agreed, CASE WHEN n = 1 AND cast_ >= 2 THEN own ELSE a.outcome END AS outcome FROM (SELECT trial, count(DISTINCT outcome) AS n, count(outcome) AS cast_, min(outcome) AS own FROM votes GROUP BY 1) v LEFT JOIN arbiter a ON a.trial = v.trial", *VOTES))
def arbitration(s, d):
    """Two votes a trial (an order's first two lines), the order's priority deciding where they differ."""
    votes = table(s, d, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("reviewer")).agg(F.min("l_returnflag").alias("outcome"))
    arbiter = table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("trial"), F.substring("o_orderpriority", 3, 1).alias("outcome"))
    return C.agreement(votes, arbiter)


POINTS = "points AS (SELECT l_orderkey AS answer, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicted' WHEN l_returnflag = 'A' THEN 'met' ELSE 'missing' END AS state FROM lineitem)"


def points(s, d):
    state = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "contradicted").when(F.col("l_returnflag") == "A", "met").otherwise("missing")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("answer"), state.alias("state"))


@query("point_scores", oracle("SELECT answer, round(c, 6) AS completeness, CASE WHEN against = 1 THEN 'wrong' WHEN round(c, 6) = 1 THEN 'correct' WHEN round(c, 6) > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT answer, avg(CASE WHEN state = 'met' THEN 1.0 ELSE 0.0 END) AS c, max(CASE WHEN state = 'contradicted' THEN 1 ELSE 0 END) AS against FROM points GROUP BY 1)", POINTS))
def point_scores(s, d):
    return C.point_scores(points(s, d), "answer")


@query("judge_calibration", oracle("SELECT expected AS state, count(*) AS n, round(avg(CASE WHEN got = expected THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN got = expected THEN 1.0 ELSE 0.0 END), 6) >= 0.8 AS passes FROM (SELECT state AS expected, CASE WHEN l_quantity > 45 THEN 'missing' ELSE state END AS got FROM (SELECT l_quantity, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicted' WHEN l_returnflag = 'A' THEN 'met' ELSE 'missing' END AS state FROM lineitem)) GROUP BY 1"))
def judge_calibration(s, d):
    """A judge that calls every point of a large line missing."""
    state = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "contradicted").when(F.col("l_returnflag") == "A", "met").otherwise("missing")
    rows = table(s, d, "lineitem").select(state.alias("expected"), "l_quantity").withColumn("got", F.when(F.col("l_quantity") > 45, "missing").otherwise(F.col("expected")))
    return C.calibration(rows)


@query("break_even", oracle("SELECT p_partkey AS key, CASE WHEN saving > 0 AND kept THEN ceil(build / saving)::BIGINT END AS uses FROM (SELECT p_partkey, p_retailprice AS build, avg(l_extendedprice * l_discount) - 2000 AS saving, avg(l_tax) < 0.045 AS kept FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)"))
def break_even(s, d):
    """Uses after which a part's price is saved by discounts over 2,000.

    Sums are decimal, so that an average that is exactly the limit never falls below it by the order in which rows are added.
    """
    rows = table(s, d, "part").join(table(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("build"))
    total = lambda c: F.sum(c.cast("decimal(38,18)"))
    discount, tax = F.col("l_extendedprice") * F.col("l_discount"), F.col("l_tax")
    saving = total(discount).cast("double") / F.count(discount) - 2000
    return C.break_even(rows.agg(saving.alias("saving"), (total(tax) < F.lit("0.045").cast("decimal(3,3)") * F.count(tax)).alias("quality_kept")))


@query("compression_claim", oracle(
    "SELECT mechanism, n, tokens_raw, tokens_card, correct_raw, correct_card, tokens_card < tokens_raw AND correct_card >= correct_raw AS claim FROM (SELECT mechanism, count(DISTINCT task) AS n, round(sum(value) FILTER (arm = 'O'), 2) AS tokens_raw, round(sum(value) FILTER (arm = 'F'), 2) AS tokens_card, count(*) FILTER (arm = 'O' AND value > 100000) AS correct_raw, count(*) FILTER (arm = 'F' AND value > 100000) AS correct_card FROM trial GROUP BY 1)"))
def compression_claim(s, d):
    """Whether one arm takes fewer tokens with no fewer correct answers, for each case."""
    own = lambda arm, c: F.when(F.col("arm") == arm, c)
    right = lambda arm: F.count(F.when((F.col("arm") == arm) & (F.col("value") > 100000), 1))
    rows = facts.trial(s, d).groupBy("mechanism").agg(
        F.countDistinct("task").alias("n"), F.round(F.sum(own("O", F.col("value"))), 2).alias("tokens_raw"), F.round(F.sum(own("F", F.col("value"))), 2).alias("tokens_card"),
        right("O").alias("correct_raw"), right("F").alias("correct_card"))
    return rows.withColumn("claim", (F.col("tokens_card") < F.col("tokens_raw")) & (F.col("correct_card") >= F.col("correct_raw")))


@query("smoke_gate", oracle("SELECT run, count(*) AS n, count(*) FILTER (tool = 'error') AS errors, count(DISTINCT tool) AS kinds, count(*) FILTER (tool = 'error') <= 0.25 * count(*) AND count(DISTINCT tool) >= 4 AS passes FROM run_event GROUP BY 1"))
def smoke_gate(s, d):
    """A run passes with at most a quarter of errors and four kinds of calls."""
    rows = facts.run_event(s, d).groupBy("run").agg(F.count("*").alias("n"), F.count(F.when(F.col("tool") == "error", 1)).alias("errors"), F.countDistinct("tool").alias("kinds"))
    return rows.withColumn("passes", (F.col("errors") <= 0.25 * F.col("n")) & (F.col("kinds") >= 4))


@query("paired_schedule", oracle("SELECT task, arm, row_number() OVER (ORDER BY md5('17|' || task), task, md5('17|' || task || '|' || arm), arm) AS position FROM (SELECT DISTINCT task, arm FROM trial)"))
def paired_schedule(s, d):
    """All tasks in a fixed random order, arms in another within each."""
    h = lambda *c: F.md5(F.concat_ws("|", F.lit("17"), *c).cast("binary"))
    rows = facts.trial(s, d).select("task", "arm").distinct().withColumn("by_task", h(F.col("task").cast("string"))).withColumn("by_arm", h(F.col("task").cast("string"), "arm"))
    return numbered(rows, ["by_task", "task", "by_arm", "arm"], name="position").select("task", "arm", "position")


@query("question_generation", oracle(
    "SELECT family, id, gold FROM (SELECT 'callers' AS family, h.id, string_agg(c.src::VARCHAR, ',' ORDER BY c.src) AS gold FROM hub h JOIN certain c ON c.dst = h.id GROUP BY 2 UNION ALL SELECT 'callees', h.id, string_agg(c.dst::VARCHAR, ',' ORDER BY c.dst) FROM hub h JOIN certain c ON c.src = h.id GROUP BY 2 UNION ALL SELECT 'symbol', h.id, h.id::VARCHAR FROM hub h)",
    "hub AS (SELECT dst AS id FROM certain GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, 1 LIMIT 120)"))
def question_generation(s, d):
    """Questions with gold about the 120 most called nodes: their callers, their callees, themselves."""
    edges = facts.certain(s, d)
    hub = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "id").limit(120).select("id")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",").alias("gold")
    callers = hub.join(edges, F.col("id") == F.col("dst")).groupBy("id").agg(listed("src")).select(F.lit("callers").alias("family"), "id", "gold")
    callees = hub.join(edges, F.col("id") == F.col("src")).groupBy("id").agg(listed("dst")).select(F.lit("callees").alias("family"), "id", "gold")
    return C.union([callers, callees, hub.select(F.lit("symbol").alias("family"), "id", F.col("id").cast("string").alias("gold"))])


@query("nulls_last", oracle("SELECT page_id, row_number() OVER (ORDER BY ref DESC NULLS LAST, page_id) AS rank FROM (SELECT page_id, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS ref FROM pages)"))
def nulls_last(s, d):
    """Pages by a parameter that not all have; those without come last."""
    rows = table(s, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit("")).alias("ref"))
    return numbered(rows, [F.desc_nulls_last("ref"), "page_id"]).select("page_id", "rank")


@query("outline_greedy", oracle(
    "SELECT host, page_id, size, page, size > 40000 AS oversize FROM walk",
    "sized AS (SELECT page_id, strlen(html) AS size, regexp_extract(url, '://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS n FROM pages)",
    "walk AS (SELECT host, page_id, size, n, 0::BIGINT AS page, size AS used FROM sized WHERE n = 1 UNION ALL SELECT s.host, s.page_id, s.size, s.n, CASE WHEN w.used + s.size > 40000 THEN w.page + 1 ELSE w.page END, CASE WHEN w.used + s.size > 40000 THEN s.size ELSE w.used + s.size END FROM walk w JOIN sized s ON s.host = w.host AND s.n = w.n + 1)"))
def outline_greedy(s, d):
    """A host's pages dealt to outline pages of 40,000 bytes, each closed before it would overflow."""
    rows = table(s, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id", F.octet_length("html").cast("bigint").alias("size"))
    return C.greedy_pages(rows, "host", "page_id", "size", 40000)


@query("token_normalisation", oracle("SELECT page_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS fingerprint FROM (SELECT page_id, list_filter(regexp_extract_all(array_to_string(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's'), chr(10)), '" + C.TOKEN.replace("'", "''") + "'), lambda x: NOT starts_with(x, '//') AND NOT starts_with(x, '/*')) AS t FROM pages)"))
def token_normalisation(s, d):
    """Tokens of all of a page's scripts, hashed without white space and comments."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1)), "\n")
    rows = table(s, d, "pages").select("page_id", C.normal_tokens(scripts).alias("t"))
    return rows.select("page_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("fingerprint"))


@query("comment_compaction", oracle("SELECT page_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/|//[^\\n]*', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM pages)"))
def comment_compaction(s, d):
    rows = table(s, d, "pages").select("page_id", C.compacted("html").alias("c"))
    return rows.select("page_id", F.length("c").cast("bigint").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("definition_hash", oracle("SELECT doc_id, sha256(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))) AS hash FROM documents WHERE text IS NOT NULL"))
def definition_hash(s, d):
    """SHA-256 of the exact bytes of a span: each text's first three lines."""
    from heddle.sources.files import read_span

    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2(read_span("text", 1, 3), 256).alias("hash"))


@query("identifier_text", oracle(
    "SELECT id, substr(sha1(concat_ws('::', kind, name, id)), 1, 20) AS short, trim(regexp_replace(regexp_replace(replace(name, ' ', '_'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_ ]+', ' ', 'g')) AS words, array_to_string(regexp_extract_all(replace(name, ' ', '_t ') || '_s', '\\b\\w*(?:_t|_s|_e)\\b')[1:6], ',') AS types FROM node"))
def identifier_text(s, d):
    """Short ids, humanised names and key types of nodes."""
    name = F.regexp_replace("name", " ", "_")
    typed = F.concat(F.regexp_replace("name", " ", "_t "), F.lit("_s"))
    return facts.node(s, d).select("id", short_id("kind", "name", F.col("id").cast("string")).alias("short"), C.humanised(name).alias("words"), F.array_join(C.key_types(typed), ",").alias("types"))


@query("tag_remap", oracle("SELECT doc_id, md5(regexp_replace('[A1] ' || text || ' [A12][B2]', '\\[A([0-9]+)\\]', '[E\\1]', 'g')) AS digest FROM documents WHERE text IS NOT NULL"))
def tag_remap(s, d):
    """Neutral tags in texts that get two of them."""
    tagged = F.concat(F.lit("[A1] "), "text", F.lit(" [A12][B2]"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(C.remapped(tagged, "A", "E").cast("binary")).alias("digest"))


@query("url_parts", oracle("SELECT page_id, regexp_replace(url, '^([a-z+]+://)[^/@]*@', '\\1') AS url, regexp_extract(url, '([^/]*)$', 1) AS base FROM (SELECT page_id, replace(url, '://', '://user:pw@') AS url FROM pages)"))
def url_parts(s, d):
    """URLs, given credentials, without them, and their last parts."""
    from heddle.sources.files import basename

    rows = table(s, d, "pages").withColumn("url", F.regexp_replace("url", "://", "://user:pw@"))
    return rows.select("page_id", C.without_credentials("url").alias("url"), basename("url").alias("base"))


@query("key_value_upsert", oracle("SELECT user_id AS key, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"))
def key_value_upsert(s, d):
    """The last value of each key, from an old and a new batch of writes."""
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("at"))
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    return C.upsert(rows.where(F.col("at.ts") < half), rows.where(F.col("at.ts") >= half), "key", "at").select("key", "value")


@query("skip_if_equal", oracle("SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'build' WHEN n.path IS NULL THEN 'drop' WHEN o.h = n.h THEN 'skip' ELSE 'rebuild' END AS action FROM heads_old o FULL JOIN heads_new n ON o.path = n.path",
    "heads_old AS (SELECT path, sha1(string_agg(name, '|' ORDER BY name, id)) AS h FROM node WHERE p_size < 45 GROUP BY 1)", "heads_new AS (SELECT path, sha1(string_agg(name, '|' ORDER BY name, id)) AS h FROM node WHERE p_size > 1 AND path <> 'Brand#7/PROMO' GROUP BY 1)"))
def skip_if_equal(s, d):
    """What to do with each file's head, from the contents' hashes of two versions."""
    def heads(rows, name):
        listed = F.array_sort(F.collect_list(F.struct("name", "id")))
        return rows.groupBy("path").agg(F.sha1(F.array_join(F.transform(listed, lambda x: x["name"]), "|").cast("binary")).alias(name))

    nodes = facts.node(s, d)
    both = heads(nodes.where("p_size < 45"), "o").join(heads(nodes.where("p_size > 1 and path <> 'Brand#7/PROMO'"), "n"), "path", "full")
    action = F.when(F.col("o").isNull(), "build").when(F.col("n").isNull(), "drop").when(F.col("o") == F.col("n"), "skip").otherwise("rebuild")
    return both.select("path", action.alias("action"))


@query("rebuild_changed_units", oracle(
    "SELECT src, dst, confidence, count(DISTINCT tu) AS n_obs FROM (SELECT * FROM edge_obs WHERE tu NOT IN (SELECT tu FROM changed) UNION ALL SELECT tu, dst, src, confidence FROM edge_obs WHERE tu IN (SELECT tu FROM changed)) GROUP BY 1, 2, 3",
    "changed AS (SELECT o_orderkey AS tu FROM orders WHERE o_orderstatus = 'P')"))
def rebuild_changed_units(s, d):
    """Edges after pending orders were read anew with every edge turned round; the oracle rebuilds all from the changed table."""
    from heddle.operators.graph import dedup_edges
    from heddle.operators.incremental import refresh

    observed = facts.edge_obs(s, d)
    changed = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tu"))
    again = observed.join(changed, "tu", "left_semi").select("tu", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    return dedup_edges(refresh(observed, again))


@query("orphans_after_removal", oracle("SELECT kind, id FROM (SELECT 'node' AS kind, id FROM node WHERE id NOT IN (SELECT src FROM strong UNION SELECT dst FROM strong) UNION ALL SELECT 'edge', src FROM (SELECT DISTINCT src FROM edge WHERE src NOT IN (SELECT id FROM node WHERE p_size <= 40)))", "strong AS (SELECT src, dst FROM edge WHERE n_obs >= 2)"))
def orphans_after_removal(s, d):
    """Nodes on no edge that two units saw, and starts of edges whose node a version without large parts lacks."""
    from heddle.operators.incremental import orphans

    edges, nodes = facts.edge(s, d), facts.node(s, d)
    used = edges.where("n_obs >= 2").select(F.explode(F.array("src", "dst")).alias("used"))
    lost = orphans(edges.select(F.col("src").alias("id")).distinct(), "id", nodes.where("p_size <= 40"), "id")
    return orphans(nodes.select("id"), "id", used, "used").select(F.lit("node").alias("kind"), "id").unionByName(lost.select(F.lit("edge").alias("kind"), "id"))


@query("fingerprint_catalog", oracle("SELECT 'node' AS kind, id::VARCHAR AS name, sha1(concat_ws('|', name, kind, path)) AS hash FROM node UNION ALL SELECT 'module', path, " + facts.rollup_sql('id', 'name') + " FROM node GROUP BY path"))
def fingerprint_catalog(s, d):
    """Hashes of nodes, and of modules over their nodes' names."""
    nodes = facts.node(s, d)
    own = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("name"), F.sha1(F.concat_ws("|", "name", "kind", "path").cast("binary")).alias("hash"))
    mods = merkle(nodes, "path", "id", "name")
    return own.unionByName(mods.select(F.lit("module").alias("kind"), F.col("path").alias("name"), "hash"))


@query("interval_containment", oracle("SELECT doc_id, a AS anchor, count(*) AS n FROM (SELECT doc_id, unnest(range(0, n_chars, 500)) AS a FROM documents) JOIN (SELECT doc_id AS d, unnest(range(0, n_chars, 60)) AS s FROM documents) ON d = doc_id AND s <= a AND a < s + 90 GROUP BY 1, 2"))
def interval_containment(s, d):
    """How many citation ranges of 90 characters hold each anchor; a range offers the cells it touches, so the join is on equality."""
    docs = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars"))
    long = F.lit(0).cast("bigint")
    at = docs.select("doc_id", F.explode(F.sequence(long, F.col("n_chars") - 1, F.lit(500).cast("bigint"))).alias("anchor")).withColumn("cell", F.floor(F.col("anchor") / 90))
    span = docs.select("doc_id", F.explode(F.sequence(long, F.col("n_chars") - 1, F.lit(60).cast("bigint"))).alias("start"))
    cells = span.select("doc_id", "start", F.explode(F.sequence(F.floor(F.col("start") / 90), F.floor((F.col("start") + 89) / 90))).alias("cell"))
    return at.join(cells, ["doc_id", "cell"]).where("start <= anchor and anchor < start + 90").groupBy("doc_id", "anchor").agg(F.count("*").alias("n"))


@query("set_equality", oracle("SELECT mechanism, count(*) FILTER (side = 'both') AS n_common, count(*) FILTER (side <> 'both') = 0 AS equal FROM (SELECT mechanism, task, CASE WHEN bool_or(arm = 'F') AND bool_or(arm = 'O') THEN 'both' ELSE 'one' END AS side FROM trial WHERE arm IN ('F', 'O') GROUP BY 1, 2) GROUP BY 1"))
def set_equality(s, d):
    """Whether two arms cover exactly the same tasks, for each mechanism."""
    sides = facts.trial(s, d).where("arm in ('F', 'O')").groupBy("mechanism", "task").agg((F.countDistinct("arm") == 2).alias("both"))
    return sides.groupBy("mechanism").agg(F.count(F.when(F.col("both"), 1)).alias("n_common"), F.min("both").alias("equal"))
