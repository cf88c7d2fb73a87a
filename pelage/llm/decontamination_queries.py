"""Query of the benchmark decontamination over all documents and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import decontamination
from pelage.llm.registry import query, table

c = F.col

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, len(x) AS n_shingles, unnest(x) AS s
  FROM (SELECT item_id, {_SHINGLES} AS x FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, count(*) AS n_shared
FROM d JOIN b ON d.s = b.s GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8
"""


@query("op4_decontamination", SQL)
def op4(spark, sf_dir):
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(c("doc").alias("doc_id"), c("item").alias("item_id"), "n_shingles", "n_shared")
