"""Writers. The scalable form of every sink is a table or a set of bounded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.functions import geometry as G
from pelage.functions.text import flat_label_name, label_path
from pelage.operators.boxes import pose_box, yolo_box
from pelage.sources.label_files import write_label_files

c = F.col

# Images or boxes per COCO document.
DOCUMENT_ROWS = 5_000


def coco_documents(images: DataFrame, boxes: DataFrame, categories: list[dict], rows: int | None = None) -> DataFrame:
    """``split, text``: COCO JSON documents of about ``DOCUMENT_ROWS`` images or boxes each.

    ``images``: split, id, file_name, width, height; ``boxes``: id, image_id,
    category_id, x, y, w, h, area, iscrowd. Images and boxes are dealt to
    documents by their own hash, so an image with very many boxes is spread too
    (a reader joins by image_id anyway).
    """
    rows = max(images.count(), boxes.count()) if rows is None else rows
    documents = max(1, -(-rows // DOCUMENT_ROWS))

    def dealt(df: DataFrame):
        return df.withColumn("_doc", F.pmod(F.xxhash64("id"), F.lit(documents)))

    image = F.struct("id", "file_name", "width", "height")
    annotation = F.struct("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area", "iscrowd")
    listed_images = dealt(images).groupBy("split", "_doc").agg(F.sort_array(F.collect_list(image)).alias("images"))
    split_boxes = boxes.join(images.select(c("id").alias("image_id"), "split"), "image_id")
    listed_boxes = dealt(split_boxes).groupBy("split", "_doc").agg(
        F.sort_array(F.collect_list(annotation)).alias("annotations"))
    named = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in category.items()]) for category in categories])
    both = listed_images.join(listed_boxes, ["split", "_doc"], "full")
    document = F.struct(
        F.coalesce("images", F.array().cast(listed_images.schema["images"].dataType)).alias("images"),
        F.coalesce("annotations", F.array().cast(listed_boxes.schema["annotations"].dataType)).alias("annotations"),
        named.alias("categories"))
    return both.select("split", F.to_json(document).alias("text"))


def write_coco(images: DataFrame, boxes: DataFrame, categories: list[dict], path: str) -> None:
    """One document per line, in one folder per split (``split=train`` …)."""
    coco_documents(images, boxes, categories).write.mode("overwrite").partitionBy("split").text(path)


def _lines(images: DataFrame, found: DataFrame, name) -> DataFrame:
    return images.select("image_id", name.alias("label_path")).join(found, "image_id", "left").select(
        "label_path", "ann_key", "box", "points")


def yolo_detection_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``label_path, ann_key, box, points``: a row per box that is left after clamping, and one with a
    NULL box for an image without any. The table form of label files; an image's boxes are rows at every number."""
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    found = yolo_box(sized).select(
        "image_id", "ann_key", F.array(F.lit(0.0), "xc", "yc", "w", "h").alias("box"), F.lit(None).cast("array<double>").alias("points"))
    return _lines(images, found, label_path(c("file_name")))


def yolo_pose_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Same with keypoints and without clamping (boxes carry ``keypoints, num_keypoints``); all files lie in one folder."""
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    points = G.normalized_keypoints(c("keypoints"), c("num_keypoints"), c("width"), c("height"))
    flat = F.flatten(F.transform(points, lambda k: F.array(k["x"], k["y"], k["v"])))
    found = pose_box(sized.withColumn("points", flat)).select(
        "image_id", "ann_key", F.array(F.lit(0.0), "xc", "yc", "w", "h").alias("box"), "points")
    return _lines(images, found, flat_label_name(c("file_name")))


def write_yolo_detection(images: DataFrame, boxes: DataFrame, root: str) -> None:
    """A label file per image below ``root``."""
    paths = images.select(label_path(c("file_name")).alias("label_path"))
    write_label_files(yolo_detection_lines(images, boxes), root, order="ann_key", paths=paths)


def write_yolo_pose(images: DataFrame, boxes: DataFrame, root: str, joints: int = 4) -> None:
    write_label_files(yolo_pose_lines(images, boxes), root, joints=joints, order="ann_key")


def sorted_paths(images: DataFrame, path: str = "file_name", data_root: str = "") -> DataFrame:
    """Image paths in order (a range sort, no single task)."""
    full = c(path) if not data_root else F.concat(F.lit(data_root.rstrip("/") + "/"), c(path))
    return images.select(full.alias("path")).orderBy("path")


def write_split_lists(images: DataFrame, path: str) -> None:
    """Sorted path list per split, as text files in order below ``split=train`` and ``split=val``."""
    images.select("split", c("file_name").alias("path")).orderBy("split", "path").write.mode(
        "overwrite").partitionBy("split").text(path)


def dataset_config(categories: DataFrame, path: str, train: str, val: str, keypoints: bool = False) -> DataFrame:
    """One-row descriptor of a converted dataset; class names in id order."""
    names = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("_c"))
    fields = [F.lit(path).alias("path"), F.lit(train).alias("train"), F.lit(val).alias("val"),
              F.size("_c").cast("long").alias("nc"), F.transform("_c", lambda k: k["name"]).alias("names")]
    if keypoints:
        fields += [F.array(F.lit(len(G.JOINT_INDEX)), F.lit(3)).alias("kpt_shape"),
                   F.array(*[F.lit(i) for i in G.FLIP_INDEX]).alias("flip_idx")]
    return names.select(*fields)


def write_dataset_config(config: DataFrame, target: str) -> None:
    config.write.mode("overwrite").json(target)


def write_identity_splits(images: DataFrame, path: str) -> None:
    """``file_path, identity_label, breed_label`` per split."""
    images.select("split", "file_path", "identity_label", F.lit("unknown").alias("breed_label")).write.mode(
        "overwrite").partitionBy("split").json(path)


def write_eval_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_metrics(log: DataFrame, path: str) -> None:
    """Append ``run, metric, value`` rows to the metric log."""
    log.write.mode("append").parquet(path)


def write_training_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)
