"""DuckDB SQL for the queries that SQL can express."""

OP7 = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM t),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
k AS (SELECT source, h, sum(size)::BIGINT AS last FROM s GROUP BY source, h),
c AS (SELECT *, (sum(last) OVER (PARTITION BY source ORDER BY h))::BIGINT - last AS below FROM k),
e AS (
  SELECT b.source, min_by(CASE WHEN abs(below + last - budget) < abs(below - budget) THEN h + 1 ELSE h END, h) AS edge
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE below + last > budget GROUP BY b.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
       s.size * (b.passes + CASE WHEN s.h < coalesce(e.edge, 1152921504606846976) THEN 1 ELSE 0 END) AS taken,
       b.passes + CASE WHEN s.h < coalesce(e.edge, 1152921504606846976) THEN 1 ELSE 0 END AS copies
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON s.source IS NOT DISTINCT FROM e.source
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w) WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.w) = len(a.w) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
           lambda r, x: xor(r // 256, steps[xor(r % 256, x) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), k),
n AS (SELECT conv_id AS base, count(*) AS turns FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(n.turns, 0)) + t.pos - c.h, role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN n ON n.base = c.base),
p AS (
  SELECT conv_id, d, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS key,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
x AS (
  SELECT key, d, count(*) AS n_convs, min(conv_id) AS conv_id, max(words) AS words FROM p GROUP BY key, d),
e AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, key FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY key),
ch AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM x WHERE d > 0 GROUP BY 1),
s AS (
  SELECT key[1:g.k] AS key, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (SELECT x.*, ch.key IS NULL AS leaf FROM x LEFT JOIN ch ON ch.key = x.key), unnest(range(0, d + 1)) AS g(k) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, o.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, coalesce(ch.n_children, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM x JOIN s ON s.key = x.key LEFT JOIN ch ON ch.key = x.key LEFT JOIN e ON e.key = x.key
LEFT JOIN x o ON o.d = x.d - 1 AND o.key = x.key[1:x.d - 1]
"""

ORACLE = {"op11_hard_negatives": OP11, "op12_conversation_trie": OP12, "op5_top_products": OP5, "op7_mix_sources": OP7}
