"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 500)) AS o FROM d WHERE len(h) >= 200) x),
s AS (SELECT doc_id, o + i AS b, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, o, h, unnest(range(0, least(500, len(h) // 2 - 99))) AS i FROM c) x),
r AS (SELECT doc_id, b FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY k ORDER BY doc_id, b) AS rn FROM s) x WHERE rn > 1),
e AS (SELECT doc_id, b, coalesce(b > lag(b) OVER w + 100, TRUE) AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
i AS (SELECT doc_id, b, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY b) AS k FROM e),
spans AS (SELECT doc_id, k, min(b) AS b, max(b) + 100 AS e FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS prior FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (b - prior)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS h, sum(e - b) AS n, count(*) AS n_spans
  FROM g JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0) x),
x AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
dw AS (SELECT rid, i, m, string_agg(x, ' ') OVER v AS s, count(*) OVER v AS n FROM x, (SELECT DISTINCT m FROM bw) z WINDOW v AS (PARTITION BY rid, m ORDER BY i ROWS BETWEEN CURRENT ROW AND m - 1 FOLLOWING)),
h AS (SELECT rid, i, m, item FROM dw JOIN bw USING (m, s) WHERE n = m),
hw AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM h) x GROUP BY 1),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c(x, y) AS (SELECT x, y FROM p UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY 1), r AS (SELECT x, least(x, min(y)) AS root FROM c GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN r ON r.x = vec_id"""

MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({_PLAIN}) AS BIGINT) AS size, md5('curriculum:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    substr(md5(coalesce(text, '')), 1, 8) AS tie FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY 1),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, (SELECT arg_min(level, (most / weight, place)) FROM l WHERE most / weight >= level) * weight) AS target FROM l),
o AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, CAST((SELECT sum(least(size, greatest(floor(target + 1e-6) - (start + source_size * k), 0))) FROM range(3) r(k)) AS BIGINT) AS taken FROM o"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
s AS (SELECT doc_id, p, md5(string_agg(x, ' ') OVER v) AS k, count(*) OVER v AS n FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM s WHERE n = 20) y WHERE rn > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_CODES = "list_transform(string_split({0}, ''), lambda c: unicode(c))"

SPELLING_VARIANTS = f"""WITH RECURSIVE t AS (SELECT unnest({_CRC_TABLE}) AS v, unnest(range(256)) AS k),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT row_number() OVER () AS rid, id, run, c FROM (SELECT id, translate(run, '{_UP}', '{_LOW}') AS run, count(*) AS c FROM d GROUP BY 1, 2) x),
s AS (SELECT rid, flatten(list_transform({_CODES.format("id || ':' || run")}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END)) AS b FROM r),
h(rid, b, pos, crc) AS (SELECT rid, b, 1, 4294967295::BIGINT FROM s UNION ALL
  SELECT rid, b, pos + 1, xor(crc >> 8, v::BIGINT) FROM h JOIN t ON t.k = xor(crc, b[pos]::BIGINT) & 255 WHERE pos <= len(b)),
g AS (SELECT rid, xor(crc, 4294967295) AS h FROM h WHERE pos = len(b) + 1),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM r JOIN g USING (rid)),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) y),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b USING (i, less) WHERE a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.less UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.less),
o AS (SELECT a, count(*) AS n_near, max(w.n) AS most FROM p JOIN w ON w.word = p.b GROUP BY 1),
f AS (SELECT o.a AS word, min(p.b) AS form, any_value(most) AS form_n FROM o JOIN p USING (a) JOIN w ON w.word = p.b AND w.n = most JOIN w own ON own.word = o.a WHERE most >= 5 * own.n GROUP BY 1),
z(word, root, step) AS (SELECT word, form, 1 FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root),
l AS (SELECT word, arg_max(root, step) AS root FROM z GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n FROM w LEFT JOIN f USING (word) LEFT JOIN l USING (word) LEFT JOIN o ON o.a = word"""

RANKED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
n AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT iid, item_id, t, count(*) AS c FROM (SELECT iid, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS iid, item_id, {_ALNUM} AS w FROM benchmark) x) y GROUP BY 1, 2, 3),
x AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) y WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
v AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM x GROUP BY 1) y, g),
s AS (SELECT iid, item_id, doc_id, rid, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN v USING (t) JOIN x USING (t) JOIN n USING (rid), g GROUP BY 1, 2, 3, 4),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
c AS (SELECT s, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (5 * (3 - k))) & 31 AS INT) + 1, 1), '' ORDER BY g, k) AS payload_digest
  FROM (SELECT s, g, CAST('0x' || substr(s, CAST(5 * g + 1 AS INT), 5) AS BIGINT) AS v FROM (SELECT DISTINCT s FROM d) x, range(8) r(g)) y, range(4) q(k) GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN c USING (s)"""

ORACLE_SQL = {"op1_suffix_dedup": SUFFIX_DEDUP, "op4_decontamination": DECONTAMINATION, "op7_embedding_dedup": EMBEDDING_DEDUP, "op9_mixing": MIXING,
              "op10_substring_dedup": SUBSTRING_DEDUP, "op11_spelling_variants": SPELLING_VARIANTS, "op12_ranked_search": RANKED_SEARCH, "op13_warc": WARC}
