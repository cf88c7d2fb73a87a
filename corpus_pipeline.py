"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read back as the next stage's documents. All but the last keep the columns
of ``documents``. NULL texts pass as empty ones, rows with a NULL id are never
merged with others, and an empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelage.llm import decontamination, jaccard_join, secret_scan
from pelage.llm.importance import Sampler
from pelage.llm.packing_queries import pack
from pelage.llm.registry import table
from pelage.llm.secret_queries import repository
from pelage.llm.storage import stored
from pelage.operators.prefix import unused

c = F.col


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample does not draw go, toxic ones among them."""
    return Sampler(docs, table(spark, sf_dir, "labels"), reject_toxic=True).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with the smallest id stays.

    Rows of one id with different texts are one document and stay together; of
    those with equal texts the first by its other columns stays. Rows with a
    NULL id all stay.
    """
    (gone_id,) = unused(docs, "gone")
    groups = jaccard_join.similar_groups(docs, k=5, percent=80)
    gone = stored(groups.where("id <> component").select(c("id").alias(gone_id)), "pipeline-duplicates")
    left = docs.join(gone, c("doc_id") == c(gone_id), "left_anti")
    # Only rows whose id repeats are compared, so that texts of all others need no shuffle.
    again = docs.where(c("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(c("doc_id").alias(gone_id))
    again = stored(again, "pipeline-repeats")
    once = left.join(again, c("doc_id") == c(gone_id), "left_anti")
    repeated = left.join(again, c("doc_id") == c(gone_id), "left_semi")
    return once.unionByName(_first_of_equal_texts(repeated))


def _first_of_equal_texts(rows: DataFrame) -> DataFrame:
    others = [k for k in rows.columns if k not in ("doc_id", "text")]
    if not others:
        return rows.distinct()
    (row,) = unused(rows, "row")
    kept = rows.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias(row))
    return kept.select("doc_id", "text", f"{row}.*").select(*rows.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a benchmark item go; others of the same id, also a NULL one, stay."""
    gone_id, version = unused(docs, "gone", "gone_version")
    found = decontamination.contained_versions(docs, table(spark, sf_dir, "benchmark"))
    gone = found.select(c("doc").alias(gone_id), c("version").alias(version)).distinct()
    return docs.join(gone, c("doc_id").eqNullSafe(c(gone_id)) & (F.xxhash64("text") == c(version)), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials that are not widely copied are cut out of the texts; no document goes."""
    scanned = stored(secret_scan.scan(docs, "doc_id", "text", *repository(docs)), "secret-scan")
    clean = secret_scan.redact(docs, "doc_id", "text", secret_scan.judge(scanned))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and place."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

# Model weights, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
