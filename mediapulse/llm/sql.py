"""SQL of the queries whose whole tables DuckDB can work through."""

from __future__ import annotations

from . import rules


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_COUNT = lambda text, pattern: f"len(regexp_extract_all({text}, {_quoted(pattern)}))"
#: Over whole tables: op7 by all pairs of a label, op9 by joining word windows, op11 line by line, op12 by all products of
#: anchors and rows, op13 by the search with plain strings.
SQL = {
    "op11_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_quoted(rules.WORD)}) AS words FROM d),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) > 2),
t AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM t WHERE n > 1) GROUP BY doc_id),
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT doc_id, lines[k] AS line, k FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM split)),
c AS (
  SELECT *, {_COUNT("line", rules.WORD)} AS n, {_COUNT("line", rules.SEPARATOR)} AS separators,
         {_COUNT(f"regexp_replace(line, {_quoted(rules.BULLET)}, '')", rules.SYMBOL)} AS symbols, {_COUNT("line", rules.SHOUT)} AS shouts,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again
  FROM l),
f AS (
  SELECT doc_id, n, again, (separators >= 2 AND separators * 4 >= n) OR (symbols >= 3 AND symbols * 2 >= n)
         OR (shouts >= 2 AND shouts * 3 >= n) OR (n < {rules.OPEN_WORDS} AND NOT regexp_matches(line, {_quoted(rules.CLOSED)}))
         OR (n <= {rules.PHRASE_WORDS} AND regexp_matches(line, {_quoted(rules.BOILERPLATE)})) OR again AS fails
  FROM c WHERE n > 0),
k AS (SELECT doc_id, count(*) AS n_lines, count_if(NOT fails) AS n_kept_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS n_kept_words, count_if(again) AS n_dup_lines FROM f GROUP BY doc_id),
z AS (
  SELECT doc_id, len(words) AS n_words, length(text) - {_COUNT("text", rules.SPACE)} AS word_chars, {_COUNT("text", rules.SYMBOL)} AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_kept_lines, 0) AS n_kept_lines, CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND 100 * (n_words - n_kept_words) <= {rules.MOST_LOST} * n_words AS kept
FROM z""",
    "op12_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS nth
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  WHERE 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE nth <= 5""",
    "op7_nn_descent": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding, embedding) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept, CAST(1 AS DOUBLE) AS audit_recall
FROM c LEFT JOIN n USING (vec_id)""",
    "op9_decontamination": r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM t),
i AS (SELECT id, words, least(10, len(words)) AS n FROM w WHERE side = 'b' AND len(words) > 0),
k AS (SELECT DISTINCT id, n, array_to_string(words[p:p + n - 1], ' ') AS key FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM i)),
x AS (SELECT id, n, p, array_to_string(words[p:p + n - 1], ' ') AS key
      FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM i) WHERE side = 'd' AND len(words) >= n)),
h AS (SELECT x.id, x.p, x.n, k.id AS item FROM x JOIN k ON k.n = x.n AND k.key = x.key),
c AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT id, p, n FROM h)) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h WHERE item IS NOT NULL) GROUP BY id)
SELECT w.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN m USING (id) WHERE side = 'd'""",
    "op13_conversation_repair": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(k, ''),
           lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) % 20 AS code
  FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(bare, '[.!?]$') THEN 't' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
ins AS (SELECT * FROM (VALUES (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2), (2, 2, 2), (3, 3, 2), (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)) x(a, b, j)),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, b AS state, CAST(3 * j AS BIGINT) AS cost, repeat('I', j) AS audit
  FROM conversations, ins WHERE a = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT s.conv_id, f.i, ins.b AS state, s.cost + e.cost + CASE WHEN fault = 't' AND e.x <> 'D' THEN 3 ELSE 0 END + 3 * j AS cost, s.audit || e.x || repeat('I', j) AS audit
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    JOIN (VALUES ('D', 4), ('R', 3), ('K', 0)) e(x, cost)
      ON e.x = 'D' OR fault NOT IN ('b', 'd') AND (e.x = 'R' OR role[1] = 's' AND state = 0 OR role[1] = 'u' AND state <> 2 OR role[1] = 'a' AND state = 2)
    JOIN ins ON ins.a = CASE WHEN e.x = 'D' THEN state WHEN e.x = 'K' AND role[1] = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
g AS (SELECT conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN f USING (conv_id) GROUP BY conv_id),
b AS (
  SELECT g.conv_id, cost, audit FROM g JOIN s ON s.conv_id = g.conv_id AND s.i = g.n WHERE state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY g.conv_id ORDER BY cost, audit) = 1),
l AS (SELECT conv_id, p, audit[p] AS x, length(regexp_replace(audit[1:p], 'I', '', 'g')) AS i, length(regexp_replace(audit[1:p], 'D', '', 'g')) AS e
      FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM b)),
t AS (
  SELECT l.conv_id, l.p, l.x, l.e, CASE WHEN x <> 'I' THEN f.role ELSE '' END AS role, CASE WHEN x <> 'I' THEN f.text ELSE '' END AS text,
         max(CASE WHEN x = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS offs
  FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.i = l.i WHERE x <> 'D'),
r AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (e - offs) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole
  FROM t GROUP BY conv_id),
m AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
         count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM b LEFT JOIN m USING (conv_id) LEFT JOIN r USING (conv_id)""",
}
