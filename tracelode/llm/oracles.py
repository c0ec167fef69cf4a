"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import op2_licenses
from .common import LOWER, UPPER

_SPLIT = f"list_filter(regexp_split_to_array(translate(coalesce({{0}}, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

EMBEDDING_LINKS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
),
good AS (
  SELECT r, vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
),
p AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= CAST(0.93 AS DOUBLE)
),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY 1),
deg AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)
"""

MIXING_WORDS = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * source_size AS lim FROM ranked),
x AS (SELECT *, lim / weight AS ratio FROM w),
y AS (
  SELECT *,
    (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(lim) OVER before, 0))
      / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS per
  FROM x WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (SELECT source, source_size, least(lim, (SELECT per FROM y WHERE per <= ratio ORDER BY ratio, rank LIMIT 1) * weight) AS target FROM y),
placed AS (
  SELECT d.*, source_size, target, CAST(floor(target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS take,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(place + size, take) - place)
  + greatest(0, least(place + size + source_size, take) - place - source_size)
  + greatest(0, least(place + size + 2 * source_size, take) - place - 2 * source_size) AS BIGINT) AS taken
FROM placed
"""

JACCARD_CLASSES = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("text")} AS w FROM documents),
g AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
),
s AS (SELECT r, len(g) AS n, unnest(g) AS s FROM g),
p AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r GROUP BY ALL)
  WHERE 100 * o >= 90 * (na + nb - o)
),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT g.doc_id, CAST(len(any_value(g.g)) AS BIGINT) AS n_shingles, min(w.doc_id) AS component_id
FROM reach JOIN g ON reach.a = g.r JOIN w ON reach.b = w.r GROUP BY g.r, g.doc_id
"""

BENCHMARK_LEAKS = f"""
WITH i AS (SELECT row_number() OVER () AS k, item_id, {_SPLIT.format("text")} AS w FROM benchmark),
ig AS (
  SELECT k, item_id, least(len(w), 5) AS width, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM i WHERE len(w) > 0
),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("text")} AS w FROM documents),
dg AS (
  SELECT r, doc_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' ')))) AS s
  FROM d JOIN (SELECT DISTINCT width FROM ig) x ON len(w) >= width
),
m AS (
  SELECT r, doc_id, k, item_id, any_value(n) AS n, count(*) AS o
  FROM dg JOIN (SELECT k, item_id, width, len(g) AS n, unnest(g) AS s FROM ig) x USING (width, s) GROUP BY r, doc_id, k, item_id
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, o AS n_found FROM m WHERE 10 * o >= 8 * n
"""

CONVERSATION_TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL
),
o AS (SELECT conv_id, list({m: m, n: len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, m) AS turns FROM t GROUP BY conv_id),
f AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS root, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'),
      lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 4 AS h
  FROM o
),
c AS (
  SELECT f.conv_id, list_concat(coalesce(o.turns[1:f.h], []), f.turns[f.h + 1:]) AS turns FROM f LEFT JOIN o ON o.conv_id = f.root
),
x AS (SELECT conv_id, turns, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth FROM c),
p AS (SELECT conv_id, n, depth, list_transform(turns[1:depth], lambda e: e.m) AS path, coalesce(turns[depth].n, 0) AS words FROM x),
g AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth
),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (path, depth)),
up AS (SELECT path[1:d] AS path, d AS depth, n_children, (n_convs - 1) * words AS own FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v)),
s AS (SELECT path, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY path, depth)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (path, depth) LEFT JOIN g u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1]
"""

LEXICAL_SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
i AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
it AS (SELECT k, item_id, unnest(list_distinct(w)) AS t FROM i),
a AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n) // l AS m FROM d, a WHERE len(w) > 0),
s AS (
  SELECT k, item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM it JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY k, item_id, r
),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


def oracles() -> dict[str, str]:
    return {
        "op2_license_units": op2_licenses.oracle_sql(), "op4_embedding_links": EMBEDDING_LINKS, "op8_mixing_words": MIXING_WORDS,
        "op9_jaccard_classes": JACCARD_CLASSES, "op10_benchmark_leaks": BENCHMARK_LEAKS,
        "op11_conversation_trie": CONVERSATION_TRIE, "op13_lexical_ranks": LEXICAL_SEARCH,
    }
