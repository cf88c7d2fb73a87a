"""File sources of annotation data, all read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelage.functions.geometry import triples
from pelage.functions.text import folder_name
from pelage.sources.files import qualified, walk
from pelage.sources.label_files import read_label_folder

c = F.col

IMAGE_SUFFIX = r"\.(jpg|jpeg|png)$"

_COCO_SCHEMA = """
images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT, source_dataset: STRING>>,
annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>,
    area: DOUBLE, iscrowd: INT, keypoints: ARRAY<DOUBLE>, num_keypoints: BIGINT>>,
categories ARRAY<STRUCT<id: BIGINT, name: STRING, supercategory: STRING>>
"""

_VOC_SCHEMA = """
filename STRING, size STRUCT<width: INT, height: INT>,
object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>>>,
_corrupt_record STRING
"""

_KEYPOINT_SCHEMA = """
img_path STRING, img_bbox ARRAY<DOUBLE>, joints ARRAY<ARRAY<DOUBLE>>, is_multiple_dogs BOOLEAN
"""

_HISTORY_SCHEMA = """
epoch INT, phase STRING, train_loss DOUBLE, val_metrics MAP<STRING, DOUBLE>, epoch_time DOUBLE
"""


def read_coco(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of COCO documents.

    A document is read by one task; large sets come as many documents or, with
    ``multi_line=False``, as one document per line. A missing list is empty.
    """
    docs = spark.read.schema(_COCO_SCHEMA).json(path, multiLine=multi_line)
    box = {k: F.get("bbox", i) for i, k in enumerate("xywh")}
    annotations = docs.select(F.inline("annotations")).select(
        "id", "image_id", "category_id", *[v.alias(k) for k, v in box.items()], "area",
        F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), "keypoints", "num_keypoints")
    categories = docs.select(F.posexplode("categories").alias("position", "k")).select("position", "k.*")
    return {
        "images": docs.select(F.inline("images")),
        "annotations": annotations,
        "categories": categories,
    }


def _voc(spark: SparkSession, path: str) -> DataFrame:
    docs = (
        spark.read.format("xml").option("rowTag", "annotation").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true")
        .schema(_VOC_SCHEMA).load(path)
    )
    return docs.withColumn("_file", c("_metadata.file_path")).filter(c("_corrupt_record").isNull())


def read_voc_boxes(spark: SparkSession, path: str, image_root: str = "stanford_dogs/images") -> DataFrame:
    """One row per object: ``file_name, width, height, xmin, ymin, xmax, ymax``.

    The class folder is the parent of the XML file. Broken documents, template
    names and repeated images are skipped.
    """
    docs = _voc(spark, path).filter(c("filename").isNotNull() & ~c("filename").contains("%s"))
    docs = docs.filter(c("size.width").isNotNull() & c("size.height").isNotNull())
    folder = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    named = docs.withColumn("file_name", F.concat(
        F.lit(image_root.rstrip("/") + "/"), folder, F.lit("/"), c("filename"), F.lit(".jpg")))
    first = named.groupBy("file_name").agg(F.min_by(F.struct("size", "object"), "_file").alias("d"))
    return first.select("file_name", "d.size.width", "d.size.height", F.explode("d.object").alias("o")).select(
        "file_name", "width", "height", "o.bndbox.*")


def read_voc_negatives(spark: SparkSession, path: str, image_root: str = "oxford_pets/images",
                       target: str = "dog") -> DataFrame:
    """``file_name, width, height`` of the images whose first named object is not the target."""
    first = F.get(F.filter(F.transform("object", lambda o: o["name"]), lambda n: n.isNotNull()), 0)
    return _voc(spark, path).filter(first != target).select(
        F.concat(F.lit(image_root.rstrip("/") + "/"), c("filename")).alias("file_name"),
        c("size.width").alias("width"), c("size.height").alias("height"))


def read_keypoint_entries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``img_path, x, y, w, h, joints, is_multiple_dogs``."""
    entries = spark.read.schema(_KEYPOINT_SCHEMA).json(path, multiLine=multi_line)
    box = [F.get("img_bbox", i).alias(k) for i, k in enumerate("xywh")]
    return entries.select("img_path", *box, "joints", "is_multiple_dogs")


def identity_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """``identity, path`` of the images in a listing: the folder of a file is its
    identity. With ``root`` paths below it become relative to it; others stay."""
    identity = folder_name(c("path"))
    path = c("path") if root is None else F.regexp_replace(
        "path", "^(?:.*?/)?" + _quoted(root.strip("/")) + "/", "")
    return files.filter(F.lower("path").rlike(IMAGE_SUFFIX)).select(identity.alias("identity"), path.alias("path"))


def scan_identity_folders(spark: SparkSession, path: str) -> DataFrame:
    """``identity, path`` of the images in one folder per identity; a missing folder is an empty table."""
    return identity_files(walk(spark, path))


def scan_priority_identities(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Same with paths relative to ``root``."""
    return identity_files(walk(spark, path), root)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_identity_list(spark: SparkSession, path: str, label_type: str = "string", multi_line: bool = True) -> DataFrame:
    """``image_path, identity_label``; items without an identity stay NULL
    (see ``filter_unlabelled``)."""
    schema = f"file_path STRING, image_path STRING, identity_label {label_type}"
    items = spark.read.schema(schema).json(path, multiLine=multi_line)
    return items.select(F.coalesce("image_path", "file_path").alias("image_path"), "identity_label")


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """``file, cls, xc, yc, w, h, keypoints`` of the label text files below a folder; empty files give no rows."""
    lines = read_label_folder(spark, path).filter(c("box").isNotNull())
    names = ("cls", "xc", "yc", "w", "h")
    return lines.select(
        c("label_path").alias("file"), *[F.get("box", i).alias(k) for i, k in enumerate(names)],
        triples(F.coalesce("points", F.array().cast("array<double>"))).alias("keypoints"))


def read_images(spark: SparkSession, path: str, keep_failed: bool = False) -> DataFrame:
    """``path, height, width, nChannels, data`` of the images below a folder.

    A file that cannot be decoded is left out, or with ``keep_failed`` a row
    whose pixels and size are NULL: models skip it and it counts as an image
    without an animal.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option(
        "recursiveFileLookup", "true").load(qualified(spark, path))
    valid = c("image.height") > 0
    # The source escapes its paths as in a URI.
    origin = F.url_decode(F.replace(c("image.origin"), F.lit("+"), F.lit("%2B")))
    rows = images.select(origin.alias("path"), *[
        F.when(valid, c(f"image.{k}")).alias(k) for k in ("height", "width", "nChannels", "data")])
    return rows if keep_failed else rows.filter(c("height").isNotNull())


def read_training_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Epoch log with ``map_score`` taken out of the metrics."""
    history = spark.read.schema(_HISTORY_SCHEMA).json(path, multiLine=multi_line)
    return history.withColumn("map_score", c("val_metrics")["mAP"])

