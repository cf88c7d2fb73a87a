"""Query of the resharding operator over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import resharding
from pelage.llm.registry import query, table
from pelage.llm.storage import stored
from pelage.session import scratch_dir

c = F.col
OLD_SHARDS, NEW_SHARDS = 16, 24


@query("op6_resharding")
def op6(spark, sf_dir):
    """Old layout: a source's documents lie together, so one old shard is hot.

    The touched shards are written, and shard, size and checksum are those of
    the documents in the files after that.
    """
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    slim = docs.select("doc_id", size.cast("long").alias("size"), F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")).alias("at"))
    placed = resharding.plan(slim, c("doc_id"), c("size"), c("at"), OLD_SHARDS, NEW_SHARDS)
    placed = stored(placed.drop("row"), "reshard-plan")
    path = scratch_dir(spark, "reshard-files")
    texts = docs.select("doc_id", "text")
    resharding.rewrite(texts, c("doc_id"), placed, path)
    text = F.encode(F.coalesce(c("text"), F.lit("")), "UTF-8")
    found = resharding.layout(texts, c("doc_id"), placed, path).select(
        c("doc_id").alias("key"), F.crc32(text).alias("text_crc32"), size.cast("long").alias("size"), "shard")
    return resharding.slots(found, NEW_SHARDS).select(
        c("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        c("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
