"""DuckDB SQL of the queries that SQL can state, written apart from the operators' code."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_warc": OP2, "op3_sharding": OP3, "op5_decontamination": OP5, "op6_licenses": op6(),
            "op8_near_duplicates": OP8, "pii_base": PII_BASE, "quality_base": QUALITY_BASE,
            "op12_fingerprints": OP12, "op13_hard_negatives": OP13}


OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS print
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
f AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after,
             CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM f),
l AS (SELECT *, (budget - CAST(cap_before AS DOUBLE)) / CAST(weight_after AS DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
             ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, p.pass, md5(CAST(p.pass AS VARCHAR) || ':' || d.print) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(pass)),
c AS (SELECT *, pass * source_size + coalesce(sum(size) OVER (PARTITION BY source, pass ORDER BY k, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size,
       any_value(target) AS target,
       CAST(sum(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start))) AS BIGINT) AS taken
FROM c GROUP BY r
"""

OP2 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first_id,
             row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM m
"""

OP3 = r"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
                  right(repeat('0', 60) || bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT)), 60) AS bits
           FROM documents),
n AS (SELECT substr(bits, 1, k) AS node, k, sum(bytes) AS bytes FROM d, range(0, 61) r(k) GROUP BY ALL),
f AS (SELECT * FROM n WHERE bytes <= 1048576 OR k = 60),
s AS (SELECT d.doc_id, d.bits, d.bytes, min(f.k) AS depth FROM d JOIN f ON starts_with(d.bits, f.node) AND length(f.node) = f.k GROUP BY ALL)
SELECT s.doc_id, substr(s.bits, 1, s.depth) AS shard, CAST(s.bytes AS BIGINT) AS bytes,
       CAST(f.bytes AS BIGINT) AS shard_bytes, f.bytes > 1048576 AS oversized
FROM s JOIN f ON f.k = s.depth AND f.node = substr(s.bits, 1, s.depth)
"""

OP5 = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN items ON d.r = items.r
"""


#: The sketch of ``{0}``: lower-cased words in runs of five, MD5 of each run, hashes below an eighth.
SKETCH = r"""(SELECT CASE WHEN len(h) = 0 THEN [] WHEN len(k) = 0 THEN [list_min(h)] ELSE list_sort(list_distinct(k)) END
   FROM (SELECT h, list_filter(h, lambda x: x < '2') AS k
         FROM (SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(2, len(w) - 3)), lambda i:
                           substr(md5(array_to_string(list_slice(w, i, i + 4), ' ')), 1, 16)) END AS h
               FROM (SELECT regexp_extract_all(lower({0}), '[^\x20\x09-\x0D]+') AS w))))"""
LIKENESS = """CASE WHEN {0} = {1} THEN CAST(1 AS DOUBLE) WHEN least(len({0}), len({1})) = 0 THEN CAST(0 AS DOUBLE)
  ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / least(len({0}), len({1})) END"""
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(following, 1, n // 2) AS edited FROM o),
s AS (SELECT doc_id, n, edited, {SKETCH.format('t')} AS f, {SKETCH.format('edited')} AS ef, {SKETCH.format('following')} AS nf FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f, ',') AS fingerprint,
       array_to_string(ef, ',') AS edited_fingerprint, {LIKENESS.format('f', 'ef')} AS near_edited,
       {LIKENESS.format('f', 'nf')} AS near_next
FROM s
"""


OP8 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS x, r AS y FROM d UNION SELECT c.x, e.b FROM c JOIN e ON c.y = e.a),
m AS (SELECT c.x, min(d.doc_id) AS least FROM c JOIN d ON d.r = c.y GROUP BY c.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.least AS component_id, d.doc_id = m.least AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN m ON m.x = d.r
"""

#: Spans of one kind: ``(match, start)`` lists; the pieces between the matches give the offsets.
_FOUND = r"""(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'t': m[i], 's': CAST(list_sum(list_transform(range(1, i + 1),
   lambda j: length(g[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0) AS BIGINT)}})
   FROM (SELECT regexp_extract_all(t, '{0}') AS m, regexp_split_to_array(t, '{0}') AS g))"""
_DIGITS = "regexp_replace(x.t, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1
   THEN CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER) ELSE 2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER)
   - 9 * CAST(CAST(substr(reverse({_DIGITS}), k, 1) AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"""
PII_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, doc_id,
  {_FOUND.format('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')} AS email,
  list_filter({_FOUND.format('[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)')}, lambda x:
    len(list_filter(string_split(x.t, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || right(ltrim(y, '0'), 3) AS INTEGER) > 255)) = 0) AS ip,
  list_filter({_FOUND.format('[0-9]([\\x20-]?[0-9])+')}, lambda x: length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}) AS card,
  list_filter({_FOUND.format('\\+[0-9][\\x20().0-9-]+[0-9]')}, lambda x: length({_DIGITS}) BETWEEN 9 AND 15) AS phone
  FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card,
       CAST(len(phone) AS BIGINT) AS n_phone,
       sha256(array_to_string(list_concat(
         list_transform(email, lambda x: 'email:' || x.s || ':' || (x.s + length(x.t))),
         list_transform(ip, lambda x: 'ip:' || x.s || ':' || (x.s + length(x.t))),
         list_transform(card, lambda x: 'card:' || x.s || ':' || (x.s + length(x.t))),
         list_transform(phone, lambda x: 'phone:' || x.s || ':' || (x.s + length(x.t)))), ',')) AS base_sha256
FROM f
"""
QUALITY_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS k FROM x) WHERE k > 1),
z AS (SELECT r, count(DISTINCT p) AS again FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM y) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.again, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 10 OR 100 * coalesce(z.again, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN l USING (r) LEFT JOIN z USING (r)
"""

OP13 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, c.id AS c, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM r a JOIN r c ON a.id <> c.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a AS anchor_id, p.c AS positive_id, p.score AS positive_score, s.c AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op6() -> str:
    from supportflow.llm.license_texts import LICENSES
    from supportflow.llm.licenses import SPELLINGS
    notice = (r"(^|\n)[^0-9a-z\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|by )|\(c\)[ \t]*[0-9]{4}|©)[^\n]*")
    normal = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{notice}', '\\1', 'g'), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')"
    for old, new in [("all rights reserved", ""), *SPELLINGS]:
        normal = f"replace({normal}, '{old}', '{new}')"
    one = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())
    return f"""
WITH k AS (SELECT id, {one.format(normal)} AS n FROM (VALUES {known}) v(id, text)),
kd AS (SELECT md5(n) AS digest, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM k WHERE n <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {normal} AS n FROM documents),
w AS (SELECT r, doc_id, md5({one.format('n')}) AS digest FROM d),
l AS (SELECT r, kd.ids FROM (SELECT r, unnest(string_split(n, chr(10))) AS line FROM d) x
      JOIN kd ON kd.digest = md5({one.format('line')})),
a AS (SELECT r, count(*) AS n, (SELECT string_agg(DISTINCT i, ',' ORDER BY i) FROM (SELECT unnest(flatten(list(string_split(ids, ',')))) AS i)) AS ids
      FROM l GROUP BY r)
SELECT w.doc_id, w.digest, kd.ids AS license, CAST(coalesce(a.n, 0) AS BIGINT) AS n_license_lines, coalesce(a.ids, '') AS line_licenses
FROM w LEFT JOIN kd ON kd.digest = w.digest LEFT JOIN a ON a.r = w.r
"""
