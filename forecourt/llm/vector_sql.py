"""SQL of the operators on integer vectors: mining and clustering."""

from __future__ import annotations

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

MINING = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
) WHERE rank <= 10
"""


def clustering(clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Full search in every round, one step of SQL after the other."""
    steps = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e
  FROM embeddings WHERE {_USABLE} AND len(embedding) = {width})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM k WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {clusters}))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, e, c, d FROM (
    SELECT k.r, k.vec_id, k.e, c.c, d, row_number() OVER (PARTITION BY k.r ORDER BY d, c.c) AS n
    FROM k, c{n} c, LATERAL (SELECT list_dot_product(k.e, k.e) - 2 * list_dot_product(k.e, c.e) + list_dot_product(c.e, c.e) AS d)) WHERE n = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
    SELECT c, list(floor_of ORDER BY i) AS e FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::DOUBLE AS floor_of FROM (
        SELECT c, i, sum(x::BIGINT)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY c, i)) GROUP BY c) m ON m.c = c.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""
