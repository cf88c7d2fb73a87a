"""Query of the secret scan over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import secret_scan
from pelage.llm.registry import query, table
from pelage.llm.storage import stored

c = F.col


def repository(docs):
    """Stand-ins of the synthetic table: a source is a repository, a language within it an owner."""
    return c("source"), F.concat_ws("/", F.coalesce(c("source"), F.lit("")), F.coalesce(c("lang"), F.lit("")))


@query("op7_secret_scan")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scanned = stored(secret_scan.scan(docs, "doc_id", "text", *repository(docs)), "secret-scan")
    found = secret_scan.report(scanned, secret_scan.judge(scanned))
    return found.select(
        c("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2("base", 256).alias("base_sha256"), "spans")
