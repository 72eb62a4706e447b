"""DuckDB SQL for the operators that SQL can express exactly."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes as hexadecimal text: two characters a byte. A span ends 50 bytes behind its last repeated start.
REPEATS = r"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
start AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM raw, LATERAL (SELECT unnest(range(0, length(h) // 2 - 49)) AS i) WHERE length(h) >= 100),
earliest AS (SELECT g, min(doc_id) AS d FROM start GROUP BY 1),
again AS (SELECT s.doc_id, s.i FROM start s JOIN earliest e ON e.g = s.g WHERE e.d < s.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY 1, 2),
piece AS (SELECT doc_id, a AS at, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b, a AS e FROM span
  UNION ALL SELECT r.doc_id, length(h) // 2, coalesce(max(z), 0), length(h) // 2 FROM raw r LEFT JOIN span s ON s.doc_id = r.doc_id GROUP BY r.doc_id, h),
kept AS (SELECT p.doc_id, string_agg(substr(r.h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS h FROM piece p JOIN raw r ON r.doc_id = p.doc_id GROUP BY 1),
total AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT r.doc_id, length(r.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM raw r JOIN kept k ON k.doc_id = r.doc_id LEFT JOIN total t ON t.doc_id = r.doc_id
"""

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS e FROM documents UNION SELECT r.d, l.y FROM reach r JOIN link l ON l.x = r.e),
least AS (SELECT d, min(e) AS m FROM reach GROUP BY 1)
SELECT d AS doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, d = m AS kept FROM least LEFT JOIN n ON n.doc_id = d
"""

# CRC-32 by a table of its 256 remainders, itself from the rule; the polynomial is the usual reversed one.
IMPORTANCE = rf"""
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
doc AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
feature AS MATERIALIZED (SELECT k, unnest(ws) AS w FROM doc),
aim AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT w FROM feature UNION SELECT w FROM aim), crc),
s AS (SELECT b, count(*) AS s FROM feature JOIN word USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM aim JOIN word USING (w) GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM feature)::DOUBLE AS all_s, (SELECT count(*) FROM aim)::DOUBLE AS all_t),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), total),
own AS (SELECT k, sum(g)::BIGINT AS weight FROM feature JOIN word USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (SELECT d.k, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM doc d LEFT JOIN own o ON o.k = d.k),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (10 * n) // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked x ON x.k = s.k
"""

NEGATIVES = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5
"""
