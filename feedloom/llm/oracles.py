"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8 = """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), k AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9
), r(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other
), c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 4
), g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM g
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY 1
), ln AS (
  SELECT doc_id, source, t, trim(regexp_replace(regexp_replace(lower(x), '\s+', ' ', 'g'), '[0-9]+', '0', 'g')) AS k, len({_WORDS.format("x")}) AS n
  FROM (SELECT doc_id, source, t, unnest(l) AS x FROM d)
), often AS (
  SELECT source, k FROM ln GROUP BY 1, 2 HAVING count(DISTINCT t) > 20
), lost AS (
  SELECT doc_id, sum(n) AS lost FROM ln JOIN often o ON o.source IS NOT DISTINCT FROM ln.source AND o.k = ln.k GROUP BY 1
), m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM f
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP5 = f"""
WITH d AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), x AS (SELECT page_id, last, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM x
"""

#: Phrases and their labels.
_PHRASES = "[{'p': ['under', 'the', 'mit', 'license'], 'k': 'mit'}, {'p': ['apache', 'license', 'version', '2'], 'k': 'apache-2'}, {'p': ['cc', 'by', 'nc'], 'k': 'cc-by-nc'}]"

LICENSE_BASE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (SELECT x.p AS words, x.k AS k FROM (SELECT unnest({_PHRASES}) AS x)), f AS (
  SELECT doc_id, k, unnest(list_filter(range(1, len(w) - len(words) + 2), lambda i: w[i:i + len(words) - 1] = words)) - 1 AS i FROM d, p
), g AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, array_to_string(list_sort(list_distinct(list(k))), ',') AS k FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(k, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

MIX_BOUNDS = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY 1),
w AS (SELECT source, s, 1 + (rn - 1) % 3 AS w, sum(s) OVER () AS every FROM t),
b AS (SELECT *, coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT source, s, w, max((every - before)::DOUBLE / rest) OVER () AS level FROM b)
SELECT doc_id, size, s AS source_size, least((3 * s)::DOUBLE, level * w) AS target, true AS whole_copies, true AS within FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""

MIX_TOTALS = f"SELECT DISTINCT source, source_size, target, true AS near FROM ({MIX_BOUNDS}) JOIN documents USING (doc_id)"

UNDETERMINED = r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS undetermined FROM documents"

OP12 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""

ORACLES: dict[str, str] = {
    "op5_warc_archive": OP5, "op7_minhash_dedup": OP7, "op8_embedding_dedup": OP8, "op9_quality_rules": OP9, "op12_hard_negatives": OP12,
    "license_base_places": LICENSE_BASE, "mixing_bounds": MIX_BOUNDS, "mixing_totals": MIX_TOTALS, "language_undetermined": UNDETERMINED,
}
