"""DuckDB SQL for the queries that SQL can express, over the tables registered as views."""

QUALITY = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS k FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
s AS (SELECT doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / n) AS m, greatest(var_pop(failed / n) - avg(failed / n) * (1 - avg(failed / n)) * avg(1.0 / n), 1e-9) AS v FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / v - 1, 2.0), 1e6) AS q FROM m),
b AS (SELECT source, m * q + failed AS a, (1 - m) * q + n - failed AS b FROM h, p),
r AS (SELECT source, source IS NOT NULL AND a / (a + b) - 2.0 * sqrt(a * b / (a + b) / (a + b) / (a + b + 1)) > 0.5 AS rejected FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, rejected AS host_rejected
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

#: SHA-1 in base32: each group of five bits of the hex digest is one letter.
WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h,
  CASE WHEN url IS NULL OR url = '' THEN 'urn:none' ELSE url END AS url FROM pages),
n AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p),
d AS (SELECT *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS x FROM n),
e AS (SELECT *, list_transform(range(0, 160), lambda j: (x[j // 4 + 1] >> (3 - j % 4)) & 1) AS bit FROM d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', bit[5 * k + 1] * 16 + bit[5 * k + 2] * 8 + bit[5 * k + 3] * 4 + bit[5 * k + 4] * 2 + bit[5 * k + 5] + 1, 1)), '') AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to, url, '2024-01-01T00:00:00Z' AS date FROM e
"""

#: Links by all pairs that share a shingle, components by reachability.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: The template adds 20 characters a turn, and escapes what stands in roles and texts.
CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
f AS (SELECT *, length(replace(replace(replace(replace(r, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>'))
  + length(replace(replace(replace(replace(x, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>')) + 20 AS size FROM e),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(r, chr(10), x, chr(10)), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS told,
  coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g
"""

#: Every string of 50 bytes (a hash of its hex digits) with the smallest document that has it; removed runs are merged where they meet.
REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, j, substr(h, 2 * j + 1, 610) AS t FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 256)) AS j FROM d)),
g AS (SELECT doc_id, j + i AS i, hash(substr(t, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, j, t, unnest(range(0, least(256, len(t) // 2 - 49))) AS i FROM b)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM g JOIN m USING (s) WHERE least < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
f AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
x AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM f GROUP BY doc_id, span),
y AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
z AS (SELECT d.doc_id, h, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed,
  concat(coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), ''), substr(h, 2 * coalesce(max(b), 0) + 1)) AS kept FROM d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id, h)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM z
"""
