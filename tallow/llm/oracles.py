"""SQL of the subpackage's queries, for DuckDB."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), i AS (SELECT row_id, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v),
s AS (
  SELECT q.row_id AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM i q JOIN i c ON q.vec_id % 50 = 0 AND q.row_id <> c.row_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

CHAT = """
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations GROUP BY conv_id
), whole AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
inner_part AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM whole)),
stays AS (SELECT * FROM whole WHERE l NOT IN (SELECT l FROM inner_part))
SELECT conv_id, len(l)::INTEGER AS n_turns,
  array_to_string(list_transform(l, lambda t: '<|im_start|>' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM stays
"""

LINES = r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND text <> ''),
raw AS (SELECT text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM texts),
line AS (
  SELECT text, ln, array_to_string(list_transform(string_split(trim(regexp_replace(l, '[ \t\r\x0B\f]+', ' ', 'g')), ' '),
    lambda w: CASE WHEN regexp_matches(w, '[0-9@]') THEN '<*>' ELSE w END), ' ') AS x
  FROM raw
), d AS (SELECT DISTINCT text, x, string_split(x, ' ') AS w FROM line),
ranked AS (SELECT text, x, row_number() OVER (PARTITION BY text ORDER BY length(x) DESC, x DESC) AS r FROM d WHERE x <> ''),
-- a template is a line, or what a line of 5 to 32 words says outside of one half of what follows its lead
says AS (
  SELECT text, x, unnest(CASE WHEN len(w) BETWEEN 5 AND 32 THEN [
    {'n': len(w), 'lead': w[1:3], 'one': w[4:3 + (len(w) - 2) // 2], 'two': NULL}, {'n': len(w), 'lead': w[1:3], 'one': NULL, 'two': w[4 + (len(w) - 2) // 2:]}
    ] ELSE [{'n': len(w), 'lead': w, 'one': NULL, 'two': NULL}] END) AS template
  FROM d WHERE len(w) >= 3
), many AS (
  SELECT template FROM says s LEFT JOIN ranked o ON o.text = s.text AND o.x <> s.x AND o.r <= 2
    AND o.r = (SELECT min(p.r) FROM ranked p WHERE p.text = s.text AND p.x <> s.x AND p.r <= 2)
  GROUP BY template HAVING count(DISTINCT o.x) >= 5 AND count(DISTINCT o.x) >= 0.2 * count(*)
), drops AS (SELECT DISTINCT text, x FROM says WHERE template IN (SELECT template FROM many)),
gone AS (SELECT text, ln FROM line SEMI JOIN drops USING (text, x)),
left_over AS (
  SELECT text, string_agg(l, chr(10) ORDER BY ln) AS kept FROM raw WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.text = raw.text AND g.ln = raw.ln) GROUP BY text
), n AS (SELECT text, count(*) AS n_dropped FROM gone GROUP BY text)
SELECT doc_id, CASE WHEN n_dropped IS NULL THEN d.text ELSE coalesce(kept, '') END AS text, lang, source, n_chars,
  (CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE length(d.text) - length(replace(d.text, chr(10), '')) + 1 END)::INTEGER AS n_lines,
  coalesce(n_dropped, 0)::INTEGER AS n_dropped
FROM documents d LEFT JOIN n ON n.text = d.text LEFT JOIN left_over o ON o.text = d.text
"""

REPEATS = """
WITH whole AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
t AS (SELECT row_number() OVER () AS k, text, lower(hex(encode(text))) AS x, octet_length(encode(text)) AS n FROM whole),
copies AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text),
piece AS (SELECT k, n, c, substr(x, 2 * c + 1, 2 * (100 + 199)) AS y FROM (SELECT k, x, n, unnest(range(0, n - 199, 100)) AS c FROM t WHERE n >= 200)),
w AS (SELECT k, c + j AS i, md5_number(substr(y, 2 * j + 1, 400)) AS h FROM (SELECT k, c, y, unnest(range(0, least(100, n - 199 - c))) AS j FROM piece)),
h AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (
  SELECT k, i AS a, i + 200 AS b FROM w SEMI JOIN h USING (h)
  UNION ALL SELECT k, 0, t.n FROM t JOIN copies c USING (text) WHERE c.n > 1 AND t.n >= 200
), o AS (SELECT k, a, b, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT k, a, b, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o),
r AS (SELECT k, g, min(a) AS a, max(b) AS b FROM g GROUP BY k, g),
part AS (
  SELECT k, a, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0))) AS p FROM r JOIN t USING (k)
  UNION ALL SELECT k, n, substr(x, 2 * coalesce(stop, 0) + 1) FROM t LEFT JOIN (SELECT k, max(b) AS stop FROM r GROUP BY k) USING (k)
), kept AS (SELECT k, sha256(unhex(string_agg(p, '' ORDER BY a))) AS sha FROM part GROUP BY k),
n AS (SELECT k, sum(b - a)::BIGINT AS gone, count(*) AS n_spans FROM r GROUP BY k)
SELECT doc_id, t.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha AS kept_sha256
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN kept USING (k) LEFT JOIN n USING (k)
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), c AS (SELECT row_number() OVER () AS k, s, len(s) AS n FROM (SELECT DISTINCT s FROM s WHERE len(s) > 0)),
sh AS (SELECT k, n, unnest(s) AS x FROM c),
l AS (SELECT a.k AS a, b.k AS b FROM sh a JOIN sh b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT k AS a, k AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
d AS (SELECT s.doc_id, k, s.s FROM s LEFT JOIN c ON c.s = s.s),
least AS (SELECT reach.a AS k, min(d.doc_id) AS component_id FROM reach JOIN d ON d.k = reach.b GROUP BY reach.a),
size AS (SELECT k, count(*) AS class_size FROM d WHERE k IS NOT NULL GROUP BY k)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id, coalesce(class_size, 1)::BIGINT AS class_size
FROM d LEFT JOIN least USING (k) LEFT JOIN size USING (k)
"""
