"""The same results in SQL for DuckDB, from plain definitions."""

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM g JOIN f USING (g) WHERE f.first < doc_id),
r AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ats, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
k AS (SELECT d.doc_id, coalesce(any_value(x.key), 'short ' || array_to_string(any_value(d.w), ' ')) AS key, any_value(x.n) AS n
  FROM d LEFT JOIN (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS key, count(*) AS n FROM s GROUP BY doc_id) x USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT key, min(doc_id) AS class_id, any_value(n) AS n FROM k GROUP BY key),
r AS (SELECT s.doc_id, s, n FROM s JOIN c ON c.class_id = s.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach(v, w) AS (SELECT class_id, class_id FROM c UNION SELECT v, b FROM reach JOIN pairs ON a = w)
SELECT k.doc_id, class_id, coalesce(l.n, 0) AS n_links, g.group_id FROM k JOIN c USING (key)
  LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON a = class_id JOIN (SELECT v, min(w) AS group_id FROM reach GROUP BY v) g ON v = class_id
"""


def quality_sql(buckets: int, threshold: int) -> str:
    """Words by list functions, CRC-32 byte by byte over the distinct grams, and the rest as defined."""
    return f"""
WITH RECURSIVE t(k, n, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(0, 256) r(i) UNION ALL SELECT k, n + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE n < 8),
crc AS (SELECT list(c ORDER BY k) AS v FROM t WHERE n = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g)),
b AS (SELECT g, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda a, y: xor(a >> 8, v[CAST(xor(a, y) & 255 AS BIGINT) + 1])), 4294967295) % {buckets} AS INT) AS bucket FROM h, crc),
o AS (SELECT doc_id, bucket, t.good FROM g JOIN b USING (g) LEFT JOIN (SELECT DISTINCT doc_id, 1 AS good FROM labels WHERE quality = 1 AND toxic = 0) t USING (doc_id)),
n AS (SELECT bucket, count(*) AS raw, count(good) AS good FROM o GROUP BY bucket),
m AS (SELECT sum(raw) AS raw, sum(good) AS good FROM n),
l AS (SELECT bucket, CASE WHEN m.good = 0 THEN 0 ELSE CAST(round((ln((n.good + 1) / (m.good + {buckets})) - ln((n.raw + 1) / (m.raw + {buckets}))) * 1e6) AS BIGINT) END AS weight FROM n, m),
e AS (SELECT doc_id, count(*) AS n_grams, sum(weight) AS llr FROM o JOIN l USING (bucket) GROUP BY doc_id),
p AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
q AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS pos FROM p JOIN (SELECT doc_id, z FROM p GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, z)) GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(e.n_grams, 0) AS BIGINT) AS n_grams, CAST(coalesce(e.llr, 0) AS BIGINT) AS llr_millionths
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND llr_millionths >= {threshold} * n_grams AS kept FROM f
"""
