"""SQL of target-distribution resampling: CRC by bytes from a table that its rule builds, then plain aggregates."""

from __future__ import annotations


def resample_sql(buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    """The rows of :func:`marketspark.llm.target_resampling.resample` for runs of one and two words."""
    return f"""WITH RECURSIVE table256 AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS b)),
w AS (SELECT 0 AS own, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
 UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT own, r, unnest(ws) AS f FROM w UNION ALL SELECT own, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
crc AS (SELECT f, x, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM h
 UNION ALL SELECT f, x, i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN table256 t ON t.b = xor(crc.c & 255, CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) WHERE 2 * i < length(x)),
bucket AS (SELECT f, xor(c, 4294967295) % {buckets} AS b FROM crc WHERE 2 * i = length(x)),
hits AS (SELECT own, r, b FROM f JOIN bucket USING (f)),
n AS (SELECT b, count(*) FILTER (own = 0) AS s, count(*) FILTER (own = 1) AS t FROM hits GROUP BY b),
tot AS (SELECT count(*) FILTER (own = 0) AS s_all, count(*) FILTER (own = 1) AS t_all FROM hits),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + {buckets} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {buckets} AS DOUBLE)))) AS BIGINT) AS g FROM n, tot),
d AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS total FROM hits JOIN g USING (b) WHERE own = 0 GROUP BY r),
s AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
 CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r) WHERE own = 0),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM s),
k AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS p,
 count(*) FILTER (n_words >= {least_words}) OVER () * {percent} // 100 AS drawn FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN p <= drawn THEN p END AS rank FROM k"""
