"""Query of the substring dedup over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import repeated_spans
from pelage.llm.registry import query, table

c = F.col


@query("op9_repeated_spans")
def op9(spark, sf_dir):
    found = repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(c("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
                        F.size("paths").alias("n_paths"))
