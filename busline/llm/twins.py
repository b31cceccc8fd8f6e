"""SQL twins of the vector and resampling queries."""

from __future__ import annotations

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE)"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """Rounds written out one after the other; ``d * k + c`` orders by distance, then number."""
    parts = [
        f"kept AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = {dim} AND {_USABLE})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
SELECT vec_id, any_value(v) AS v, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM (
SELECT vec_id, kept.v AS v, c, (list_inner_product(kept.v, kept.v) + list_inner_product(c{i}.v, c{i}.v) - 2 * list_inner_product(kept.v, c{i}.v))::BIGINT AS d
FROM kept CROSS JOIN c{i}) GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM (
SELECT c, i, sum(x::HUGEINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} USING (c)"""


def top_products_sql(k: int = 5, every: int = 50) -> str:
    return f"""WITH rows_ AS (SELECT vec_id, {_WHOLE} AS v, row_number() OVER () AS r FROM embeddings WHERE {_USABLE}),
scored AS (
SELECT q.r AS r, q.vec_id AS query_id, x.vec_id AS vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
FROM rows_ q JOIN rows_ x ON q.r <> x.r WHERE q.vec_id % {every} = 0)
SELECT query_id, rank, vec_id, score FROM (
SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank FROM scored) WHERE rank <= {k}"""


def _crc_table() -> list[int]:
    """The 256 steps of the CRC-32 of zlib, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def resample_sql(share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> str:
    """Features word by word, each distinct one hashed byte by byte through a table."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"""WITH steps AS (SELECT {_crc_table()}::BIGINT[] AS t),
doc AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
ben AS (SELECT row_number() OVER () AS r, {words} AS w FROM benchmark),
grams AS (
SELECT true AS d, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM doc
UNION ALL SELECT false, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM ben),
names AS (SELECT DISTINCT g FROM grams),
hashed AS (
SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)),
       lambda c, b: {step}), 4294967295) % {buckets} AS b FROM names, steps),
found AS (SELECT d, r, b FROM grams JOIN hashed USING (g)),
counts AS (SELECT b, count(*) FILTER (d) AS s, count(*) FILTER (NOT d) AS t FROM found GROUP BY b),
gains AS (
SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {buckets})::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM found JOIN gains USING (b) WHERE d GROUP BY r),
scores AS (
SELECT doc_id, r, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
       coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
FROM doc LEFT JOIN weights USING (r)),
placed AS (
SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS able FROM scores WHERE words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {share} * able // 100 THEN rank END AS rank FROM scores LEFT JOIN placed USING (r)"""
