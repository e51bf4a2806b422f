"""SQL twins, for DuckDB, of those operators' queries that SQL can express."""

from __future__ import annotations

#: Bytes as two hex digits each; spans of removed bytes are joined where they meet.
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
pieces AS (SELECT doc_id, c * 500 AS base, substr(h, 1000 * c + 1, 1198) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1000 + 1)) AS c FROM t)),
starts AS (SELECT doc_id, base, p, unnest(range(0, len(p) // 2 - 99)) AS k FROM pieces),
strings AS (SELECT doc_id, base + k AS s, substr(p, 2 * k + 1, 200) AS w FROM starts),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM strings) WHERE n > 1),
edges AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS new FROM again),
numbered AS (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM edges),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
cut AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, min(a) AS first, string_agg(substr(h, 2 * z + 1, 2 * (coalesce(next, len(h) // 2) - z)), '' ORDER BY a) AS rest FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN first IS NULL THEN h ELSE substr(h, 1, 2 * first) || rest END)) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
windows AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER following AS s, count(*) OVER following AS n
  FROM each WINDOW following AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
owners AS (SELECT s, min(doc_id) AS owner FROM windows WHERE n = 13 GROUP BY s),
marked AS (SELECT doc_id, i, word, n = 13 AND owner < doc_id AS again FROM windows LEFT JOIN owners USING (s)),
gone AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS out FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS k FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CHAT_FORMAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
results AS (SELECT conv_id, turn, count(*) AS n_results, CASE WHEN count(*) = count(text) THEN min(text) END AS result FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
users AS (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user'),
onward AS (SELECT u.conv_id, u.turn, r.turn IS NOT NULL AND p.turn IS NOT NULL AS builds
  FROM users u LEFT JOIN results r ON r.conv_id = u.conv_id AND r.turn = u.turn - 1 LEFT JOIN users p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2),
depths AS (SELECT conv_id, turn, CAST((turn - max(CASE WHEN NOT builds THEN turn END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn)) // 2 AS BIGINT) AS depth FROM onward),
calls AS (SELECT c.conv_id, c.turn AS position, 'turn-' || c.turn AS call_id, depth, coalesce(n_results, 0) AS n_results, c.text, result,
    concat_ws('; ', CASE WHEN c.text IS NULL THEN '$.text: not string' WHEN c.text = '' THEN '$.text: too short' END, CASE WHEN c.turn < 0 THEN '$.turn: too small' END) AS errors
  FROM t c JOIN depths USING (conv_id, turn) LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 WHERE role = 'user'),
rows AS (
  SELECT conv_id, position, call_id, depth, CASE WHEN errors <> '' THEN 'invalid_arguments' WHEN n_results > 0 THEN 'ok' ELSE 'no_result' END AS status, n_results, errors,
    '{"arguments":{"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || position || '},"call_id":"' || call_id || '","conv_id":' || conv_id || ',"depth":' || depth || ',"name":"reply","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json FROM calls
  UNION ALL
  SELECT conv_id, turn, 'turn-' || (turn - 1), NULL, 'orphan_result', n_results, '',
    '{"arguments":null,"call_id":"turn-' || (turn - 1) || '","conv_id":' || conv_id || ',"depth":null,"name":null,"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' FROM results r
  WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.conv_id = r.conv_id AND u.turn = r.turn - 1)
  UNION ALL
  SELECT conv_id, turn, NULL, NULL, 'other', 0, '',
    '{"arguments":null,"call_id":null,"conv_id":' || conv_id || ',"kind":"turn","name":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}' FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 0), position NULLS FIRST, call_id NULLS FIRST, json) AS place, position, call_id, depth, status, n_results, errors, json FROM rows
"""
