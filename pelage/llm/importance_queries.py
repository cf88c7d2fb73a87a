"""Query of the importance resampling over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm.importance import Sampler
from pelage.llm.registry import query, table

c = F.col


@query("op3_importance_sample")
def op3(spark, sf_dir):
    """The drawn documents; those that are not in the result are rejected."""
    sampler = Sampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), reject_toxic=True)
    return sampler.decided().where("kept").select(c("id").alias("doc_id"), "log_ratio", c("key").alias("sample_key"))
