"""SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

SQL = {}

SQL["op4_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS (SELECT doc_id, min(to_id) AS least_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SQL["op9_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
i AS MATERIALIZED (
  SELECT DISTINCT item_id::VARCHAR AS item, size, array_to_string(w[pos : pos + size - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM i),
t AS (SELECT doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, z WHERE len(w) >= size)),
h AS MATERIALIZED (SELECT doc_id, pos, size, item FROM t JOIN i USING (size, s)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS pos FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""

SQL["op11_substring_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
t AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d)),
h AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM t) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM h),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

SQL["op13_phrases"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
e AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS q FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM e WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, q, count(*) AS f FROM g GROUP BY lang, k, q),
t AS MATERIALIZED (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, q, k, f AS a, string_split(q, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
y AS MATERIALIZED (SELECT lang, q, a, j, array_to_string(w[1 : j], ' ') AS ql, array_to_string(w[j + 1 : k], ' ') AS qr
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
x AS (SELECT y.lang, y.q, y.a, y.j, l.f AS l, r.f AS r, n, (1000::HUGEINT * y.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM y JOIN t ON t.lang = y.lang JOIN f l ON l.lang = y.lang AND l.q = y.ql JOIN f r ON r.lang = y.lang AND r.q = y.qr),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, j) = 1),
b AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
u AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS q, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM b) GROUP BY 1, 2),
o AS (SELECT s.lang, s.q AS phrase, a, l, r, n, score FROM s LEFT JOIN u ON u.lang = s.lang AND u.q = s.q
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o QUALIFY rank <= 2000"""
