"""SQL restatements, written without the operators' constants or code."""

from __future__ import annotations

QUALITY = r"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT k, i, w FROM (
    SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM doc))),
wins AS (
  SELECT k, i, string_agg(w, ' ') OVER eight AS win, count(*) OVER eight AS n
  FROM word WINDOW eight AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM wins WHERE n = 8) WHERE c > 1),
rep AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM again GROUP BY k),
wc AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM word GROUP BY k),
line AS (SELECT k, l FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM doc)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lc AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY k),
m AS (
  SELECT doc.k, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words,
    coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM doc LEFT JOIN wc USING (k) LEFT JOIN lc USING (k) LEFT JOIN rep USING (k)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
rate AS (
  SELECT k, lang, source, base_failed, 'a' AS r, CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS v FROM f
  UNION ALL SELECT k, lang, source, base_failed, 'b', CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_symbols // n_words END FROM f
  UNION ALL SELECT k, lang, source, base_failed, 'c', CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END FROM f
  UNION ALL SELECT k, lang, source, base_failed, 'd', CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END FROM f),
low AS (
  SELECT r, lang, source, v, (v >> greatest(0, length(bin(v)) - 6)::BIGINT) << greatest(0, length(bin(v)) - 6)::BIGINT AS b
  FROM rate WHERE NOT base_failed),
q AS (
  SELECT 1 AS lvl, r, lang, source, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM low GROUP BY r, lang, source
  UNION ALL SELECT 2, r, lang, NULL, count(*), quantile_disc(b, 0.25), quantile_disc(b, 0.75) FROM low GROUP BY r, lang
  UNION ALL SELECT 3, r, NULL, NULL, count(*), quantile_disc(b, 0.25), quantile_disc(b, 0.75) FROM low GROUP BY r),
lim AS (
  SELECT rate.k, rate.r, rate.v, q.q1, q.q3, CASE WHEN rate.r = 'c' THEN 100 WHEN rate.r = 'd' THEN 80 ELSE 60 END AS floor
  FROM rate JOIN q ON q.r = rate.r AND (
    (lvl = 1 AND q.lang IS NOT DISTINCT FROM rate.lang AND q.source IS NOT DISTINCT FROM rate.source)
    OR (lvl = 2 AND q.lang IS NOT DISTINCT FROM rate.lang) OR lvl = 3)
  WHERE NOT base_failed AND (n >= 200 OR lvl = 3)
  QUALIFY row_number() OVER (PARTITION BY rate.k, rate.r ORDER BY lvl) = 1),
ok AS (
  SELECT k, bool_and(v <= q3 + 3 * greatest(q3 - q1, floor) AND (r <> 'a' OR v >= q1 - 3 * greatest(q3 - q1, floor))) AS ok
  FROM lim GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ok, TRUE) AS kept
FROM f LEFT JOIN ok USING (k)
"""


NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY, "op12_hard_negatives": NEGATIVES}
