"""Query of the suffix-array dedup over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import suffix_dedup
from pelage.llm.registry import query, table

c = F.col


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(c("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
