"""The training-data queries that SQL can express, for DuckDB: plain formulations over whole tables."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BLANK = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS g FROM cut),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM documents),
place AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM docs),
grams AS (SELECT r, i, w[i:i + l - 1] AS g FROM place, (SELECT DISTINCT len(g) AS l FROM win) WHERE i + l - 1 <= len(w)),
hits AS (SELECT r, i, len(g) AS l, item_id FROM grams JOIN win USING (g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {BLANK}) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * o >= 90 * (s.n + t.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM docs d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

MIXING = f"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {BLANK})) AS BIGINT) AS size, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
share AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sums),
capped AS (SELECT *, 2 * source_size / weight AS edge FROM share),
level AS (SELECT *, (total - coalesce(sum(2 * source_size) OVER (ORDER BY edge, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY edge, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pour FROM capped),
lambda_ AS (SELECT coalesce(arg_min(pour, (edge, source)) FILTER (WHERE pour <= edge), max(edge)) AS pour FROM level),
target AS (SELECT source, source_size, round(least(l.pour * weight, 2.0 * source_size), 6) AS target FROM level, lambda_ l),
flow AS (SELECT *, CAST(floor(target) AS BIGINT) AS f FROM target),
placed AS (SELECT d.doc_id, d.size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE f // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE f % source_size END AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM docs d JOIN flow ON flow.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST((passes + CASE WHEN rest > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
"""
#: CRC-32 is linear: each bit of each byte adds what it grows to over the bytes after it, which `step` gives by distance.
SHARDING = """
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT r, len(h) // 2 - generate_subscripts(regexp_extract_all(h, '..'), 1) AS d, unnest(regexp_extract_all(h, '..')) AS x FROM texts),
step(d, v) AS (
  SELECT 0, list_append(list_transform(range(8), lambda k: list_reduce([CAST(1 << k AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)
  UNION ALL
  SELECT d + 1, list_transform(v, lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) FROM step WHERE d < (SELECT max(len(h) // 2) FROM texts)),
codes AS (SELECT r, d, 16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1 AS b FROM bytes),
parts AS (SELECT r, bit_xor(xor(xor(xor((b & 1) * v[1], (b >> 1 & 1) * v[2]), xor((b >> 2 & 1) * v[3], (b >> 3 & 1) * v[4])), xor(xor((b >> 4 & 1) * v[5], (b >> 5 & 1) * v[6]), xor((b >> 6 & 1) * v[7], (b >> 7 & 1) * v[8])))) AS c FROM codes JOIN step USING (d) GROUP BY r),
sums AS (SELECT r, doc_id, CAST(len(h) // 2 + 16 AS BIGINT) AS size, CAST(xor(xor(coalesce(c, 0), v[9]), 4294967295) AS BIGINT) AS text_crc32 FROM texts JOIN step ON d = len(h) // 2 LEFT JOIN parts USING (r)),
walk(r, n, key, b, j) AS (
  SELECT r, n, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END), -1::BIGINT, 0::BIGINT FROM texts, (VALUES (40), (41)) s(n)
  UNION ALL
  SELECT r, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1.0))) AS BIGINT) FROM (SELECT r, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM walk WHERE j < n)),
landed AS (SELECT r, CAST(max(CASE WHEN n = 40 THEN b END) AS INTEGER) AS shard, CAST(max(CASE WHEN n = 41 THEN b END) AS INTEGER) AS grown_shard FROM walk WHERE j >= n GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32 || '|' || size), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM sums JOIN landed USING (r)
"""

#: Scores in 64-bit integers but for the terms' weights. Each item row is a query of its own.
RANKED = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM documents),
docs AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words) GROUP BY ALL),
items AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM benchmark),
asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM items) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
score AS (SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (r), size GROUP BY q, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM score JOIN items USING (q) JOIN docs USING (r) WHERE score > 0 QUALIFY rank <= 10
"""

#: A node is a list of turns; each node adds its own sums to all nodes whose list it begins with.
TRIE = """
WITH turns AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, conv_id - conv_id % 100 AS base, t, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS BIGINT) AS h FROM turns),
conv AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM crc c LEFT JOIN turns b ON b.conv_id = c.base),
member AS (SELECT conv_id, t[1:d] AS node, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM conv)),
node AS (SELECT node, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM member GROUP BY node),
tree AS (SELECT node, len(node) AS depth, conv_id, n, ids, CASE WHEN len(node) > 0 THEN node[1:len(node) - 1] END AS parent, CASE WHEN len(node) > 0 THEN (n - 1) * length(node[len(node)].text) ELSE 0 END AS saved FROM node),
kids AS (SELECT parent AS node, count(*) AS k FROM tree WHERE depth > 0 GROUP BY parent),
own AS (SELECT tree.*, coalesce(k, 0) AS k FROM tree LEFT JOIN kids USING (node)),
total AS (SELECT node[1:d] AS node, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT node, k, saved, unnest(range(depth + 1)) AS d FROM own) GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.k AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(o.ids, '')) AS ends_sha256
FROM own o JOIN total t ON t.node = o.node LEFT JOIN own p ON p.node = o.parent
"""

#: Base 32 writes five bits a digit: each five hexadecimal digits of the hash are four digits.
WARC = """
WITH rows AS (SELECT row_number() OVER (ORDER BY page_id NULLS FIRST) AS r, page_id, encode(coalesce(html, '')) AS body FROM pages),
best AS (SELECT body, arg_max(page_id, r) AS original, max(r) AS last FROM rows GROUP BY body)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(body), CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN r = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r < last THEN original END AS refers_to
FROM rows JOIN best USING (body)
"""


def llm_sql() -> dict[str, str]:
    return {"op5_ngram_join": NGRAM_JOIN, "op6_decontamination": DECONTAMINATION, "op8_mixing": MIXING, "op9_sharding": SHARDING, "op11_ranked_search": RANKED, "op12_prefix_trie": TRIE, "op13_warc": WARC}
