"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP10 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""

OP2 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 10 * count(*) >= 8 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
least AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n_links FROM pairs GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM documents d JOIN least c ON c.x = d.doc_id LEFT JOIN links l ON l.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS ws FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (g, n)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
c AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Kind, pattern and the rule that its matches must meet.
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "len(regexp_extract(s, p, 1)) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "len(s) >= 18"),
    ("hex", "[0-9a-f]+", "len(s) >= 16"),
    ("entropy", "[A-Za-z0-9+/_=-]+", """len(s) >= 20 AND NOT regexp_full_match(s, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z][A-Za-z_/=+-]*|[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}')
       AND len(list_distinct(string_split(s, ''))) > 1
       AND list_max(list_transform(range(1, len(s) - 18), lambda i: list_sum(list_transform(list_distinct(string_split(s[i:i + 19], '')),
         lambda c: (len(replace(s[i:i + 19], c, '')) - 20) / 20 * log2((20 - len(replace(s[i:i + 19], c, ''))) / 20)))))
         >= CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN 3.0 WHEN regexp_full_match(s, '[A-Z2-7=]+') THEN 3.6 ELSE 3.9 END"""),
]


def _secrets() -> str:
    parts = []
    for k, (kind, pattern, rule) in enumerate(SECRETS):
        parts.append(f"""
SELECT doc_id, '{kind}' AS kind, {k} AS k, a, a + len(s) AS z FROM (
  SELECT doc_id, p, ms[i] AS s, (list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: len(m))), 0))::BIGINT AS a
  FROM (SELECT doc_id, p, ms, regexp_split_to_array(x, p) AS gaps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, x, p, regexp_extract_all(x, p) AS ms FROM (SELECT doc_id, coalesce(text, '') AS x, '{pattern}' AS p FROM documents))))
WHERE {rule}""")
    said = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k)"
    return f"""
WITH f AS MATERIALIZED ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  {said} FILTER (k < 3) AS base, {said} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""


#: Every row is scored against every anchor.
OP11 = """
WITH r AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""

#: Every block's quotient is listed and ranked; shares are filled up in the order of 3 * size / weight.
OP12 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '~') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', '20', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (SELECT *, ('0x' || h[1:8])::BIGINT % (SELECT greatest(1, ceil(count(*) / 10000))::BIGINT FROM d) AS cell FROM d),
s AS (SELECT k, count(*) AS n, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY k) - 1 AS place, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w FROM d GROUP BY k),
f AS (
  SELECT *, row_number() OVER o AS nth, (sum(size) OVER () - coalesce(sum(3 * size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level
  FROM s WINDOW o AS (ORDER BY 3 * size / w, place)),
l AS (SELECT nth AS stop, level AS final FROM f WHERE 3 * size / w >= level ORDER BY nth LIMIT 1),
t AS MATERIALIZED (SELECT k, place, n, size, CASE WHEN nth < stop THEN (3 * size)::DOUBLE ELSE w * final END AS target FROM f, l),
b AS (SELECT greatest(1, least(256, floor(min(CASE WHEN target > 0 THEN target END) / 128)))::BIGINT AS b FROM t),
w AS (SELECT place, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place, seat) AS nth
  FROM (SELECT place, target, unnest(range(0, floor(target / b)::BIGINT + 99)) AS seat FROM t, b WHERE target > 0)),
q AS (SELECT place, count(*) AS seats FROM w, b WHERE nth <= (SELECT (sum(size)::BIGINT + b // 2) // b FROM t) GROUP BY place),
p AS MATERIALIZED (
  SELECT c.*, t.place, t.size AS source_size, target, coalesce(seats, 0) AS seats, cell % ceil(n / 10000)::BIGINT AS shard
  FROM c JOIN t USING (k) LEFT JOIN q USING (place)),
z AS (SELECT place, shard, sum(size)::BIGINT AS z, any_value(seats) AS seats FROM p GROUP BY place, shard),
y AS (SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY z / (2 * seat + 1) DESC, shard, seat) AS nth
  FROM (SELECT *, unnest(range(0, seats)) AS seat FROM z WHERE z > 0)),
x AS (SELECT place, shard, count(*) AS quota FROM y WHERE nth <= seats GROUP BY place, shard),
e AS (
  SELECT p.*, z, least(coalesce(quota, 0) * b, 3 * z) AS words, coalesce(sum(p.size) OVER (PARTITION BY place, shard ORDER BY cell, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b, p JOIN z USING (place, shard) LEFT JOIN x USING (place, shard))
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (CASE WHEN z = 0 THEN 0 ELSE words // z * size + least(greatest(words % z - before, 0), size) END)::BIGINT AS taken
FROM e
"""

SQL = {"op11_hard_negatives": OP11, "op12_mix": OP12, "op2_ngram_join": OP2, "op4_secrets": _secrets(), "op6_decontaminate": OP6, "op10_exact_dedup": OP10}
