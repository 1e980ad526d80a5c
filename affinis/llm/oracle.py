"""DuckDB SQL for the queries that SQL can express, written apart from them.

The others are tested in ``tests/llm`` against brute force, round trips and
held-out labels: spelling groups (crc32), sharding (a heap), fuzzy search, trees, SimHash (XXH64),
tokenizers, non-negative learning, best fit, and the pipeline.
"""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': replace(coalesce(text, ''), '<|im_', '<| im_')}
                       ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM t GROUP BY conv_id, own),
s AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS said FROM c),
d AS (
  SELECT conv_id, t, len(t) AS n,
    said[1 + ('0x' || md5(coalesce(conv_id::varchar, ''))[1:8])::bigint % greatest(len(said), 1)] AS hit FROM s),
p AS (SELECT *, CASE WHEN hit IS NULL OR t[hit].text = t[1].text THEN n ELSE hit - 1 END AS k FROM d),
x AS (
  SELECT conv_id, k, t[1:k] AS head, t[k + 1:n] AS good,
    CASE WHEN k = n THEN t[k + 1:n] ELSE list_concat([{'role': 'assistant', 'text': t[1].text}], t[k + 2:n]) END AS bad
  FROM p)
SELECT conv_id, k::int AS n_common,
  coalesce(array_to_string(list_transform(head, lambda y: '<|im_start|>' || y.role || chr(10) || y.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(good, lambda y: '<|im_start|>' || y.role || chr(10) || y.text || '<|im_end|>' || chr(10)), ''), '') AS chosen_completion,
  coalesce(array_to_string(list_transform(bad, lambda y: '<|im_start|>' || y.role || chr(10) || y.text || '<|im_end|>' || chr(10)), ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(good) + 1), lambda i: good[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(good[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 22)::bigint::varchar
    || ':' || (length(good[i].text) + 11)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(bad) + 1), lambda i: bad[i].role = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(bad[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 22)::bigint::varchar
    || ':' || (length(bad[i].text) + 11)), ','), '') AS rejected_mask,
  len(good) = 0 AS tied
FROM x
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
held AS (SELECT doc_id, source, line, list_filter(regexp_split_to_array(
          regexp_replace(translate(line, '{_UP}', '{_LOW}'), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY doc_id),
norm AS (SELECT doc_id, source, array_to_string(ws, ' ') AS line, sum(len(ws)) AS n FROM held GROUP BY ALL),
sig AS (SELECT doc_id, source, list_sort(list(left(md5(line), 16))) AS sig FROM norm GROUP BY doc_id, source),
freq AS (SELECT n.source, n.line FROM norm n JOIN sig s USING (doc_id)
        GROUP BY n.source, n.line HAVING count(DISTINCT sig) >= 5),
gone AS (SELECT doc_id, sum(n)::bigint AS n_removed_words FROM norm JOIN freq USING (source, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
    coalesce(n_removed_words, 0)::bigint AS n_removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - n_removed_words >= n_words * 0.3 AS kept
FROM base
"""

_OP10 = rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens)),
hit AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          sha256(string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar)) AS h FROM hit GROUP BY doc_id),
b AS (SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
        coalesce(n_items, 0)::bigint AS n_items, coalesce(h, sha256('')) AS items_sha256
      FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM b
"""


_OP12 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
         GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM shared JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b
         WHERE 100 * i >= 85 * (s.n + t.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)
"""

_OP13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0::double * x::double)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, list_dot_product(a.q, v.q)::bigint AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_format": _OP1, "op5_line_rules": _OP5, "op10_decontaminate": _OP10,
            "op12_bottomk_components": _OP12, "op13_hard_negatives": _OP13}
