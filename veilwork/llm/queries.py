"""Registered queries of the subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from veilwork.llm import ball_tree, hard_negatives, jaccard_join, language_id, line_quality, lm_mixing, packing, prefix_trie, source_mixing, substring_dedup, toxicity, url_cascade, wavelet
from veilwork.llm.tables import conversations, documents, embeddings, labels, pages

QUERIES = {
    "op1_substring_dedup": lambda spark, folder: substring_dedup.digest(documents(spark, folder)),
    "op2_lm_mixing": lambda spark, folder: lm_mixing.score(documents(spark, folder)),
    "op3_ball_tree": lambda spark, folder: ball_tree.every_nth(embeddings(spark, folder)),
    "op4_source_mixing": lambda spark, folder: source_mixing.taken(documents(spark, folder)),
    "op7_line_quality": lambda spark, folder: line_quality.judge(documents(spark, folder)).drop("row"),
    "op8_toxicity": lambda spark, folder: toxicity.digest(documents(spark, folder), labels(spark, folder)),
    "op5_language_id": lambda spark, folder: language_id.digest(documents(spark, folder)),
    "op6_packing": lambda spark, folder: packing.pack(documents(spark, folder)),
    "op9_wavelet_tokens": lambda spark, folder: wavelet.digest(documents(spark, folder)),
    "op10_jaccard_join": lambda spark, folder: jaccard_join.jaccard_join(documents(spark, folder)),
    "op11_prefix_trie": lambda spark, folder: prefix_trie.digest(conversations(spark, folder)),
    "op12_url_cascade": lambda spark, folder: url_cascade.digest_rows(pages(spark, folder)),
    "op13_hard_negatives": lambda spark, folder: hard_negatives.every_nth(embeddings(spark, folder)),
}

SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 p AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 12, 0))) AS i FROM w),
 win AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS k FROM p),
 least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
 hit AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS j FROM win JOIN least USING (k) WHERE doc_id > first),
 hits AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id),
 t AS (SELECT doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN hits USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN len(js) = 0 THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i - 1)) END, ' ')) AS kept_sha256
FROM t""",
    "op7_line_quality": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 grams AS (SELECT doc_id, i, ws[i + 1:i + 3] AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 0))) AS i FROM d)),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM twice) GROUP BY doc_id),
 cut AS (SELECT doc_id, source, t, string_split(t, chr(10)) AS ls FROM d),
 ln AS (SELECT doc_id, source, t, generate_subscripts(ls, 1) AS at, unnest(ls) AS line FROM cut),
 full_ AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
   trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_ GROUP BY doc_id),
 common AS (SELECT source, norm FROM full_ GROUP BY source, norm HAVING count(DISTINCT doc_id) > 50),
 gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS words_removed FROM full_ f WHERE EXISTS (SELECT 1 FROM common c WHERE c.norm = f.norm AND c.source IS NOT DISTINCT FROM f.source) GROUP BY doc_id),
 base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= 0.5 * n_words AS kept FROM base""",
    "op3_ball_tree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS z
  FROM (SELECT DISTINCT conv_id FROM t)),
 h AS (SELECT conv_id, base, xor(z, 4294967295) % 9 AS h FROM c),
 r AS (SELECT h.conv_id, t.i, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
  UNION ALL SELECT h.conv_id, t.i, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
 s AS (SELECT conv_id, list(sha256(concat(strlen(role), ':', role, text)) ORDER BY i) AS p, list(strlen(text) ORDER BY i) AS b FROM r GROUP BY conv_id),
 f AS (SELECT h.conv_id, coalesce(p, []) AS p, coalesce(b, []) AS b FROM h LEFT JOIN s USING (conv_id)),
 m AS (SELECT conv_id, d, len(p) AS n, array_to_string(p[1:d], '') AS k, array_to_string(p[1:d - 1], '') AS up, b[d] AS size FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM f)),
 g AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(size), 0) AS size,
   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM m GROUP BY k, d),
 kids AS (SELECT up AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY up),
 q AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (k)),
 sub AS (SELECT substr(k, 1, CAST(64 * a AS BIGINT)) AS k, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM q) GROUP BY 1)
SELECT q.conv_id, CAST(q.d AS BIGINT) AS depth, CASE WHEN q.d > 0 THEN v.conv_id END AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, q.ends AS ends_sha256
FROM q JOIN sub USING (k) JOIN g v ON v.k = q.up""",
    "op12_url_cascade": r"""
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(h, p, v)),
 u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 f AS (SELECT c.*, h, p, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
  FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM f WHERE n = 1""",
    "op13_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
