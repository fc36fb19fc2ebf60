"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

SQL["op4_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT d.doc_id, d.line, d.pos, r.k IS NOT NULL AND d.doc_id <> r.keeper AS dropped
  FROM keyed d LEFT JOIN repeated r ON d.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op5_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS holder FROM p GROUP BY h)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(p.h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN r ON p.h = r.h
"""

SQL["op11_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_dot_product(a.q, c.q)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""

SQL["op13_conversation_trie"] = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5('0:' || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i:
             CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT h.c, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.c, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.pos > h.h),
built AS (
  SELECT h.c, coalesce(list({'r': p.role, 't': p.text} ORDER BY p.part, p.pos) FILTER (WHERE p.pos IS NOT NULL), []) AS s
  FROM heads h LEFT JOIN parts p ON p.c = h.c GROUP BY h.c),
members AS (
  SELECT c, d, s[1:d] AS prefix, len(s) = d AS ends
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].t, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM members GROUP BY d, prefix),
tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.prefix[1:n.d] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1])
SELECT n.conv_id, n.d AS depth, n.parent_conv_id, n.n_convs, n.n_children,
       count(*) FILTER (WHERE k.n_children = 0) AS n_leaves,
       sum((k.n_convs - 1) * k.words)::BIGINT AS saved_tokens, n.ends_sha256
FROM tree n JOIN tree k ON k.d >= n.d AND k.prefix[1:n.d] = n.prefix
GROUP BY ALL
"""
