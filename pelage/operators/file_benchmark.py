"""From image files and a list of identities to the metric report.

The images of a folder are scored once; embeddings and what became of every
file are written as a gallery with a manifest, and ranking, verification,
reports and saved results all read that. A file that cannot be decoded and an
image without the target animal have no embedding; an entry of the list whose
file is not there has no row. All three count as "no animal" in every
denominator.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelage.operators import evaluation as E
from pelage.operators.inference import Load, score_images
from pelage.operators.retrieval import topk_neighbors
from pelage.sources.files import qualified, shared_files, write_whole
from pelage.sources.readers import read_images
from pelage.sources.sinks import append_metrics, write_eval_results

c = F.col

EMBEDDED, NO_ANIMAL, UNREADABLE = "embedded", "no_animal", "unreadable"
_MANIFEST = "_gallery.json"


@dataclass(frozen=True)
class Gallery:
    """``items``: ``image_path, status, embedding``; the numbers are those of the manifest."""

    items: DataFrame
    images: int
    embedded: int
    unreadable: int
    dimensions: int


def score_folder(spark: SparkSession, root: str, detector: Load, embedder: Load, keypoint_model: Load | None = None, **options) -> DataFrame:
    """``image_path, status, embedding`` of every image file below ``root``; paths are relative to it."""
    images = read_images(spark, root, keep_failed=True)
    scored = score_images(images, detector, embedder, keypoint_model, **options)
    folder = qualified(spark, root).rstrip("/")
    marker = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    status = F.when(c("embedding").isNotNull(), EMBEDDED).when(c("height").isNull(), UNREADABLE).otherwise(NO_ANIMAL)
    return scored.select(
        F.substring_index("path", marker, -1).alias("image_path"), status.alias("status"), "embedding")


def write_gallery(scored: DataFrame, path: str) -> Gallery:
    """Writes the scored images, then the manifest; without it a gallery is not complete."""
    spark = scored.sparkSession
    scored.write.mode("overwrite").parquet(f"{path}/items")
    items = spark.read.schema(scored.schema).parquet(f"{path}/items")
    seen = items.agg(
        F.count("*").alias("images"), F.count("embedding").alias("embedded"),
        F.count_if(c("status") == UNREADABLE).alias("unreadable"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions")).first().asDict()
    files, folder = shared_files(qualified(spark, path))
    write_whole(files, f"{folder}/{_MANIFEST}", [json.dumps(seen | {"schema": scored.schema.jsonValue()}).encode()], "gallery")
    return Gallery(items, **seen)


def open_gallery(spark: SparkSession, path: str) -> Gallery | None:
    """A gallery that was written whole; None where there is none."""
    from pyarrow import fs
    from pyspark.sql.types import StructType

    files, folder = shared_files(qualified(spark, path))
    name = f"{folder}/{_MANIFEST}"
    if files.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(name) as source:
        manifest = json.loads(source.readall())
    schema = StructType.fromJson(manifest.pop("schema"))
    return Gallery(spark.read.schema(schema).parquet(f"{path}/items"), **manifest)


def probes_of(truth: DataFrame, gallery: Gallery) -> DataFrame:
    """``id, identity_gt, has_pred, embedding`` of every entry of ``truth`` (``image_path, identity_label``)."""
    found = gallery.items.select("image_path", "embedding")
    return truth.select("image_path", "identity_label").join(found, "image_path", "left").select(
        c("image_path").alias("id"), c("identity_label").alias("identity_gt"),
        c("embedding").isNotNull().alias("has_pred"), "embedding")


def run_benchmark(
    spark: SparkSession, truth: DataFrame, root: str, output: str, detector: Load, embedder: Load,
    keypoint_model: Load | None = None, *, k: int = 10, run: str = "benchmark", **options,
) -> DataFrame:
    """Scores the folder unless ``output`` holds its gallery already, evaluates, saves, and returns the report.

    Below ``output``: ``gallery``, ``results`` (one JSON row per entry with its
    ``k`` best matches), ``metrics`` (appended under the name ``run``).
    """
    gallery = open_gallery(spark, f"{output}/gallery") or write_gallery(
        score_folder(spark, root, detector, embedder, keypoint_model, **options), f"{output}/gallery")
    probes = probes_of(truth, gallery)
    stored = f"{output}/probes"
    probes.write.mode("overwrite").parquet(stored)
    probes = spark.read.schema(probes.schema).parquet(stored)
    results = E.evaluate(probes)
    matches = topk_neighbors(E.gallery_of(probes).select("id", "embedding"), k)
    write_eval_results(E.with_matches(results, matches, k), f"{output}/results")
    saved = spark.read.schema(results.schema).json(f"{output}/results")
    report = E.report_of(probes, saved)
    append_metrics(E.metrics_log(report, run), f"{output}/metrics")
    return report
