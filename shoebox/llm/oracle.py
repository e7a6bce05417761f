"""SQL twins, for DuckDB, of the queries that SQL can express."""

ORACLES = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op10_lsh_forest"] = rf"""
WITH RECURSIVE classes AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1
), worded AS (SELECT rep, {_WORDS} AS w FROM classes WHERE len({_WORDS}) > 0),
grams AS (
  SELECT DISTINCT rep, list_aggregate(w[p : p + 4], 'string_agg', ' ') AS g
  FROM worded, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p)
), sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE 5 * n_both >= 4 * (x.n + y.n - n_both)
), reach(rep, root) AS (
  SELECT rep, rep FROM classes UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.rep AND r.root < l.a
), roots AS (SELECT rep, min(root) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS rep, count(*) AS texts, sum(copies) AS docs FROM links JOIN classes ON rep = b GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(docs, 0) + copies - 1 AS n_links, coalesce(texts, 0) AS n_text_links, copies AS n_copies
FROM documents d JOIN classes c ON c.text = coalesce(d.text, '') JOIN roots USING (rep) LEFT JOIN counts USING (rep)
"""

ORACLES["op7_prefix_decontamination"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[p : p + least(len(w), 10) - 1], 'string_agg', ' ') AS g
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(p) WHERE len(w) > 0
), places AS (
  SELECT r, n, p, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT DISTINCT r, p, x.n, item_id FROM places x JOIN windows y ON x.n = y.n AND x.g = y.g),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

# CRC-32 of the decimal id, bit by bit; 3988292384 is its reversed polynomial.
_CRC = """xor(list_reduce([4294967295::BIGINT] || [ascii(ch)::BIGINT FOR ch IN string_split(conv_id::VARCHAR, '')],
  LAMBDA acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], LAMBDA y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT)"""

ORACLES["op12_prefix_tree"] = rf"""
WITH turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(t ORDER BY pos) AS seq, {_CRC} % 4 AS h FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, coalesce(d.seq[1 : c.h], []) || c.seq[c.h + 1 :] AS seq
  FROM lists c LEFT JOIN lists d ON d.conv_id = c.conv_id - c.conv_id % 20
), members AS (SELECT conv_id, d, seq[1 : d] AS node, len(seq) = d AS ends FROM rebuilt, unnest(range(len(seq) + 1)) AS u(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), kids AS (SELECT node[1 : d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
worth AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.node = n.node
), below AS (
  SELECT node[1 : a] AS node, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM worth, unnest(range(d + 1)) AS u(a) GROUP BY 1
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM worth w JOIN below b ON b.node = w.node LEFT JOIN nodes p ON w.d > 0 AND p.node = w.node[1 : w.d - 1]
"""

ORACLES["op13_term_pipeline"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY 1, 2, 3),
found AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY 1),
scores AS (
  SELECT i, item_id, doc_id, r, sum(times * x.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN found USING (t) JOIN weights x USING (t) JOIN docs d USING (r), total GROUP BY ALL HAVING score > 0
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""
