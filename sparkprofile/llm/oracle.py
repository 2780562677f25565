"""DuckDB SQL of the operators that SQL can express, by brute force over the whole tables."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s
      FROM w WHERE len(w) > 0),
k AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM s GROUP BY s),
t AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM k),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
      FROM t a JOIN t b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep),
p AS (SELECT a, b FROM o WHERE shared >= 0.8 * (na + nb - shared) - 1e-6),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r(id, c) AS (SELECT a, a FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
g AS (SELECT id, min(c) AS c FROM r GROUP BY id),
x AS (SELECT s.doc_id, k.rep, k.copies, coalesce(n.n, 0) AS n, coalesce(g.c, k.rep) AS c
      FROM s JOIN k USING (s) LEFT JOIN n ON n.a = k.rep LEFT JOIN g ON g.id = k.rep)
SELECT d.doc_id, coalesce(rep, d.doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(n, 0) AS n_links,
       coalesce(c, d.doc_id) AS group_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN x USING (doc_id)"""

TOP_K_CODES = r"""
WITH c AS (
  SELECT vec_id AS id, list_sum(list_transform(range(0, least(len(embedding), 64)),
           lambda i: CASE WHEN isfinite(embedding[i + 1]) AND embedding[i + 1] > 0 THEN CAST(1 AS UBIGINT) << CAST(63 - i AS UBIGINT) ELSE 0 END)) AS code
  FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, x.id AS neighbor_id, CAST(bit_count(xor(CAST(q.code AS UBIGINT), CAST(x.code AS UBIGINT))) AS INTEGER) AS distance
      FROM c q JOIN c x ON q.id <> x.id WHERE q.id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10"""

REPEATED_BYTES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800),
k AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM w),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS m FROM k),
b AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM d),
c AS (SELECT b.doc_id, b.i, b.x, max(CASE WHEN m.m > 1 THEN m.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS last
      FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.i = b.i),
g AS (SELECT *, coalesce(i - last < 400, false) AS gone FROM c),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
f AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
             string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)"""

NEAR_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r(id, c) AS (SELECT a, a FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
g AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN g ON g.id = vec_id"""
