"""SQL for the queries that it can express."""

from __future__ import annotations

_OP8 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

_OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, row_number() OVER w AS i,
    CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens,
    replace(replace(text, '\', '\\'), '<|', '<\|') AS esc,
    replace(replace(role, '\', '\\'), '<|', '<\|') AS esc_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE opens WHEN 1 THEN 9 + length(esc_role) + 8 + 8 ELSE 8 END)::BIGINT AS formatted_chars,
  sum(opens)::BIGINT AS n_messages
FROM s GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b) WHERE n > 0)),
hits AS (
  SELECT DISTINCT x.doc_id, x.k, x.n, bw.item_id
  FROM (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)) x
  JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

# DuckDB has no crc32: bit by bit over the decimal's bytes.
_OP13 = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, 0 AS k, 4294967295::BIGINT AS c FROM ids
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT conv_id, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT) ELSE c END AS x
        FROM crc WHERE k < 8 * length(conv_id::VARCHAR))),
h AS (SELECT conv_id, xor(max_by(c, k), 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc GROUP BY conv_id),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i,
    length(role) || ':' || role || length(text) || ':' || text AS turn_text, length(text) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
built AS (
  SELECT h.conv_id, 0 AS own, t.i, t.turn_text, t.chars FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
  UNION ALL SELECT h.conv_id, 1, t.i, t.turn_text, t.chars FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, turn_text, chars FROM built),
named AS (
  SELECT conv_id, depth, chars, sha256(string_agg(turn_text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM h),
nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM named GROUP BY name, depth),
chain AS (SELECT n.conv_id, n.depth, a.depth AS up_depth, u.conv_id AS up_conv, n.n_convs, n.chars FROM nodes n
  JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth JOIN nodes u ON u.name = a.name AND u.depth = a.depth),
kids AS (SELECT up_conv AS conv_id, up_depth AS depth, count(*) AS n_children FROM chain WHERE up_depth = depth - 1 GROUP BY ALL),
sums AS (
  SELECT c.up_conv AS conv_id, c.up_depth AS depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((c.n_convs - 1) * c.chars)::BIGINT AS saved_tokens
  FROM chain c LEFT JOIN kids k ON k.conv_id = c.conv_id AND k.depth = c.depth GROUP BY ALL),
ends AS (SELECT name, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(name, depth) AS name, max(depth) AS depth FROM named GROUP BY conv_id) GROUP BY name, depth)
SELECT n.conv_id, n.depth, p.up_conv AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.conv_id = n.conv_id AND s.depth = n.depth
LEFT JOIN chain p ON p.conv_id = n.conv_id AND p.depth = n.depth AND p.up_depth = n.depth - 1
LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth LEFT JOIN ends e ON e.name = n.name AND e.depth = n.depth
"""

ORACLES: dict[str, str] = {"op8_exact_dedup": _OP8, "op9_chat_format": _OP9, "op12_decontamination": _OP12, "op13_prefix_trie": _OP13}
