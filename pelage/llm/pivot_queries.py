"""Query of the pivot-table clustering over all embeddings."""

from __future__ import annotations

from pelage.llm import pivot_clusters
from pelage.llm.registry import query, table

ROUNDS = 3


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT v.rowid AS row, cluster, (list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))))::BIGINT AS distance
  FROM v, c{r} c),
a{r} AS (SELECT row, min(cluster) AS cluster, distance FROM d{r} JOIN (SELECT row, min(distance) AS distance FROM d{r} GROUP BY row)
  USING (row, distance) GROUP BY row, distance)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT a.cluster, i, sum(v.q[i]) AS total, count(*) AS n FROM a{r} a JOIN v ON v.rowid = a.row, range(1, 65) AS t(i) GROUP BY ALL),
m{r} AS (SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS rowid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1)::INT AS cluster, q FROM v WHERE vec_id IS NOT NULL
  QUALIFY cluster < 16),{",".join(steps)}
SELECT v.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.rowid = a.row JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""


@query("op12_pivot_clusters", _sql())
def op12(spark, sf_dir):
    assigned, centroids = pivot_clusters.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rounds=ROUNDS)
    return pivot_clusters.report(assigned, centroids).withColumnRenamed("id", "vec_id")
