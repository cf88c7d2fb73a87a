"""Query of the embedding near-dedup over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import multi_index
from pelage.llm.registry import query, table

c = F.col

SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON v.vec_id = low.a
"""


@query("op1_multi_index", SQL)
def op1(spark, sf_dir):
    found = multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(c("id").alias("vec_id"), "n_links", c("component").alias("component_id"),
                        (c("id") == c("component")).alias("kept"))
