"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

#: A text's number of words; DuckDB's regular expressions take the same class.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

OP5 = rf"""
WITH sized AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS BIGINT) AS weight FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_size,
  CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_weight
  FROM s1 WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
s3 AS (SELECT *, total * 150 - full_size * 200 AS room FROM s2),
s4 AS (SELECT *, weight * room >= source_size * 200 * rest_weight AS is_full FROM s3),
level AS (SELECT room AS l_room, rest_weight AS l_weight FROM s4 WHERE NOT is_full ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
  ELSE CAST(weight * l_room AS DOUBLE) / CAST(100 * l_weight AS DOUBLE) END AS target FROM s4 LEFT JOIN level ON true),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)),
  CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % 32, size, doc_id NULLS FIRST) AS pos FROM sized),
rated AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.pos,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('0:offset:' || coalesce('s' || r.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS offs
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(pos * rate + offs) - floor((pos - 1) * rate + offs), 2) AS BIGINT) * size AS taken FROM rated
"""

OP9 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _lloyd(rounds: int = 10, k: int = 8) -> str:
    """Plain rounds over all pairs, one after the other."""
    away = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, e FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min({{'d': CAST({away} AS BIGINT), 'c': c}}) AS near FROM v CROSS JOIN c{r} c GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT near.c AS c, unnest(generate_series(1, 64)) AS i, unnest(e) AS x FROM a{r}),
t{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM s{r} GROUP BY c, i),
m{r} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS e FROM t{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.e, c0.e) AS e FROM c{r} c0 LEFT JOIN m{r} m ON m.c = c0.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, near.c AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = near.c"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3, "op5_source_mixing": OP5, "op6_exact_topk": OP6, "op9_line_dedup": OP9, "op12_centroid_clustering": _lloyd()}
