"""Query of the n-gram Jaccard join over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import jaccard_join
from pelage.llm.registry import query, table

c = F.col


@query("op8_jaccard_join")
def op8(spark, sf_dir):
    found = jaccard_join.similar_groups(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select(c("id").alias("doc_id"), "n_shingles", c("component").alias("component_id"))
