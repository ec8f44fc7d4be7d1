"""The queries of this folder that SQL can express, as DuckDB SQL."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPLIT = rf"regexp_split_to_array({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws, {SPLIT} AS gaps FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, greatest(2, len(ws) - 11)), lambda i: array_to_string(ws[i:i+12], ' '))) AS win FROM b WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h),
g AS (SELECT x.doc_id, count(*) AS n_hit, CAST(sum(length(d.ws[x.p]) + CASE WHEN y.p IS NULL THEN 0 ELSE length(d.gaps[x.p + 1]) END) AS BIGINT) AS hit_chars
FROM pos x JOIN d ON d.doc_id = x.doc_id LEFT JOIN pos y ON y.doc_id = x.doc_id AND y.p = x.p + 1 GROUP BY x.doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit > 0 AND 20 * n_hit >= len(d.ws), false) AS contaminated, coalesce(hit_chars, 0) AS hit_chars
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
p AS (SELECT '' AS o, 0 AS before, 0 AS bit, 0 AS step UNION ALL
  SELECT o || x.c, before | bit, x.b, step + 1 FROM p, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, b) WHERE instr(o, x.c) = 0),
s AS (SELECT full_order.o AS filter_order, p.step, p.before, p.bit FROM p JOIN (SELECT o FROM p WHERE step = 5) full_order ON p.step > 0 AND p.o = left(full_order.o, p.step)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN x ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

ORACLES = {"op1_near_dedup": OP1, "op6_decontaminate": OP6, "op11_filter_audit": OP11}
