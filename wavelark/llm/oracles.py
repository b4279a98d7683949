"""DuckDB SQL for the queries that SQL can state, over whole tables."""

_SPACED = r"'[^\x20\x09-\x0D]+'"
# After lower-casing: digits, a to z and everything beyond ASCII.
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) r USING (doc_id)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), {_LETTERS}) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), {_LETTERS}) AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, least(5, len(w)) AS n FROM i WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM k)),
dk AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
total AS (SELECT item_id, count(*) AS item_shingles FROM ik GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM dk JOIN ik USING (n, s) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared::DOUBLE / item_shingles AS containment FROM hit JOIN total USING (item_id)
WHERE 100 * shared >= 80 * item_shingles"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * part}, 10))::UBIGINT >> {35 - 5 * digit}) & 31)::BIGINT, 1)"
    for part in range(4) for digit in range(8))
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

VORONOI_JOIN = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
    FROM v q, v x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

# CRC-32 by its table: the register's next value for each byte, folded over the bytes of a feature.
_CRC = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_HEX = "('0x' || {0})::UBIGINT::BIGINT"


def _features(table: str, key: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_LETTERS})"
    return f"""SELECT {key}, len(w) AS n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
    FROM (SELECT {key}, {words} AS w FROM {table})"""


IMPORTANCE = f"""WITH {_CRC},
df AS MATERIALIZED ({_features("documents", "doc_id")}),
bf AS MATERIALIZED ({_features("benchmark", "item_id")}),
bucket AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))),
    lambda i: {_HEX.format("hex(encode(f))[2 * i + 1:2 * i + 2]")})), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b
    FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
s AS (SELECT b, count(*) AS s FROM df JOIN bucket USING (f) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM bf JOIN bucket USING (f) GROUP BY 1),
total AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS sa, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS ta),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1::DOUBLE) * (sa + 10000) / ((coalesce(s, 0) + 1::DOUBLE) * (ta + 10000)))) AS BIGINT) AS g
    FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), total),
d AS (SELECT doc_id, max(n) AS n, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM df JOIN bucket USING (f) JOIN gain USING (b) GROUP BY 1),
x AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    {_HEX.format("sha256('42:' || doc_id)[1:8]")} AS h FROM documents LEFT JOIN d USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND r <= (SELECT count(*) FROM x WHERE n >= 20) * 5 // 100 THEN r END AS rank FROM z"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, x.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
    FROM v a, v x WHERE a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
