"""DuckDB SQL for the rows of those operators that SQL can state over whole tables."""

_SPACED = r"[^\x20\x09-\x0D]+"
_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 85 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.y FROM r JOIN e ON r.z = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(z) AS c FROM r GROUP BY 1) c USING (doc_id)"""

OP4 = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_ITEM}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[s:s+9], ' ') for s in range(1, greatest(1, len(w) - 9) + 1)]) AS k FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM}') AS w FROM documents),
x AS (SELECT doc_id, z.n, unnest([{{'s': s, 'k': array_to_string(w[s:s+z.n-1], ' ')}} for s in range(1, len(w) - z.n + 2)]) AS o FROM d, (SELECT DISTINCT n FROM v) z),
h AS (SELECT x.doc_id, v.item_id, x.o.s AS s, x.n FROM x JOIN v ON x.o.k = v.k AND x.n = v.n),
m AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, unnest([{{'s': s, 'k': array_to_string(w[s:s+19], ' ')}} for s in range(1, len(w) - 18)]) AS o FROM d),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM (SELECT doc_id, o.s AS s, row_number() OVER (PARTITION BY o.k ORDER BY doc_id, o.s) AS r FROM x) WHERE r > 1),
q AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT q.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY q.p) FILTER (g.p IS NULL) AS kept FROM q LEFT JOIN g ON q.doc_id = g.doc_id AND q.p = g.p GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm FROM t),
p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y)+1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y)+1:], '') AS suffix FROM d)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(CASE WHEN plain THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""

#: CRC-32 byte by byte over each distinct word, with the table of its polynomial.
OP13 = rf"""
WITH RECURSIVE q(b, i, c) AS (SELECT b, 0, b FROM range(256) r(b) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM q WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM q WHERE i = 8),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM}') AS w FROM documents),
m AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWER}, '{_ITEM}')) AS w FROM benchmark),
e AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM d),
v AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT w FROM e UNION ALL SELECT w FROM m)),
y AS (SELECT w, hex(encode(w)) AS x FROM v),
k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, [('0x' || x[2*i+1:2*i+2])::BIGINT for i in range(len(x) // 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM y, tab),
s AS (SELECT b, count(*) AS s FROM e JOIN k USING (w) GROUP BY 1),
u AS (SELECT b, count(*) AS t FROM m JOIN k USING (w) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM u) AS t_all),
g AS MATERIALIZED (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN u USING (b), z),
f AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM e JOIN k USING (w) JOIN g USING (b) GROUP BY 1),
r AS (SELECT doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN f USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS many FROM r WHERE n_features >= 20)
SELECT r.*, CASE WHEN p <= 10 * many // 100 THEN p END AS rank FROM r LEFT JOIN o USING (doc_id)"""
