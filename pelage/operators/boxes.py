"""Row-wise box jobs on annotation and detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.functions import geometry as G

c = F.col


def filter_invalid_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.filter((c("w") > 0) & (c("h") > 0))


def _with_box(df: DataFrame, box, *drop: str) -> DataFrame:
    rest = [k for k in df.columns if k not in {"x", "y", "w", "h", "area", *drop}]
    return df.select(*rest, box.alias("_box")).select(*rest, "_box.*")


def voc_box_clean(corners: DataFrame) -> DataFrame:
    """``xmin, ymin, xmax, ymax, width, height`` to a clean box; empty boxes go."""
    box = G.clean_corners(c("xmin"), c("ymin"), c("xmax"), c("ymax"), c("width"), c("height"))
    cleaned = _with_box(corners, box, "xmin", "ymin", "xmax", "ymax")
    return filter_invalid_boxes(cleaned).withColumn("area", c("w") * c("h"))


def coco_box_clean(boxes: DataFrame) -> DataFrame:
    """``x, y, w, h, width, height`` to a clean box; empty boxes go."""
    box = G.clean_box(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    return filter_invalid_boxes(_with_box(boxes, box)).withColumn("area", c("w") * c("h"))


def yolo_box(boxes: DataFrame) -> DataFrame:
    """Box clamped to the image in normalized centre form; empty boxes go."""
    clamped = G.clamp_box(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    df = filter_invalid_boxes(_with_box(boxes, clamped))
    return _with_box(df, G.centre_form(c("x"), c("y"), c("w"), c("h"), c("width"), c("height")))


def pose_box(boxes: DataFrame) -> DataFrame:
    """Normalized centre form of the box as it is, not clamped."""
    return _with_box(boxes, G.centre_form(c("x"), c("y"), c("w"), c("h"), c("width"), c("height")))


def yolo_box_clamped_report(boxes: DataFrame) -> DataFrame:
    """Boxes which clamping changes, before and after."""
    clamped = G.clamp_box(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    df = boxes.withColumn("_c", clamped)
    changed = (
        (c("_c.x") != c("x")) | (c("_c.y") != c("y"))
        | (c("_c.x") + c("_c.w") != c("x") + c("w")) | (c("_c.y") + c("_c.h") != c("y") + c("h"))
    )
    return df.filter(changed).select(
        *[k for k in boxes.columns],
        *[c(f"_c.{k}").alias(f"clamped_{k}") for k in ("x", "y", "w", "h")],
    )


def yolo_to_pixels(labels: DataFrame) -> DataFrame:
    """``xc, yc, w, h, width, height`` to integer corners."""
    rest = [k for k in labels.columns if k not in {"xc", "yc", "w", "h"}]
    box = G.pixel_corners(c("xc"), c("yc"), c("w"), c("h"), c("width"), c("height"))
    return labels.select(*rest, box.alias("_b")).select(*rest, "_b.*")


def keypoint_crop(entries: DataFrame, padding: float = 0.2) -> DataFrame:
    """Crop window of a keypoint entry ``x, y, w, h, width, height``.

    Coordinates are truncated; a negative corner moves to 0 without shrinking
    the box, the far side is cut. Adds ``crop_x1 … crop_y2, crop_w, crop_h``
    and the box in crop space; entries with no area go.
    """
    whole = entries
    for k in ("x", "y", "w", "h"):
        whole = whole.withColumn(k, G.truncate(c(k)))
    whole = whole.dropna(subset=["x", "y", "w", "h", "width", "height"])
    whole = whole.withColumn("x", F.greatest(F.lit(0), c("x"))).withColumn("y", F.greatest(F.lit(0), c("y")))
    whole = whole.withColumn("w", F.least(c("w"), c("width") - c("x")))
    whole = filter_invalid_boxes(whole.withColumn("h", F.least(c("h"), c("height") - c("y"))))
    # A box with area inside the image has a window with area: no further filter.
    pad_w, pad_h = G.truncate(c("w") * F.lit(padding)), G.truncate(c("h") * F.lit(padding))
    framed = whole.withColumns({
        "crop_x1": F.greatest(F.lit(0), c("x") - pad_w),
        "crop_y1": F.greatest(F.lit(0), c("y") - pad_h),
        "crop_x2": F.least(c("width"), c("x") + c("w") + pad_w),
        "crop_y2": F.least(c("height"), c("y") + c("h") + pad_h),
    })
    return framed.select(
        *[k for k in entries.columns if k not in {"x", "y", "w", "h"}],
        "crop_x1", "crop_y1", "crop_x2", "crop_y2",
        (c("crop_x2") - c("crop_x1")).alias("crop_w"),
        (c("crop_y2") - c("crop_y1")).alias("crop_h"),
        (c("x") - c("crop_x1")).alias("x"),
        (c("y") - c("crop_y1")).alias("y"),
        "w", "h", (c("w") * c("h")).alias("area"),
    )


def scale_detections(raw: DataFrame, input_w: int, input_h: int, floor: float = 0.1,
                     animal_class: str = "dog") -> DataFrame:
    """Raw model rows ``x1, y1, x2, y2, confidence`` to image pixels; unsure rows go."""
    df = raw.filter(c("confidence") >= floor)
    for k, size, full in (("x1", input_w, "width"), ("x2", input_w, "width"),
                          ("y1", input_h, "height"), ("y2", input_h, "height")):
        df = df.withColumn(k, G.truncate(c(k) * c(full) / F.lit(float(size))))
    return df.withColumn("class", F.lit(animal_class))


def _window_columns(df: DataFrame, window) -> DataFrame:
    return df.withColumn("_win", window).select(
        *df.columns, *[c(f"_win.{k}").alias(f"crop_{k}") for k in ("x1", "y1", "x2", "y2")])


def detection_crop(detections: DataFrame, padding: float = 0.1) -> DataFrame:
    """Adds the crop window of a detection; NULL when it has no area."""
    return _window_columns(detections, G.detection_window(
        c("x1"), c("y1"), c("x2"), c("y2"), c("width"), c("height"), padding))


def crop_per_axis(detections: DataFrame, padding: float = 0.2) -> DataFrame:
    """Adds the crop window padded per axis; its corner is the offset."""
    return _window_columns(detections, G.per_axis_window(
        c("x1"), c("y1"), c("x2"), c("y2"), c("width"), c("height"), padding))


def keypoint_refine_crop(crops: DataFrame, threshold: float = 0.3, padding: float = 0.2) -> DataFrame:
    """Adds the refined window inside a crop (``keypoints, crop_w, crop_h``)."""
    window = G.refined_window(c("keypoints"), c("crop_w"), c("crop_h"), threshold, padding)
    return crops.withColumn("_win", window).select(
        *crops.columns, *[c(f"_win.{k}").alias(f"final_{k}") for k in ("x1", "y1", "x2", "y2")])


def closest_instance(detections: DataFrame, instances: DataFrame, key: str, frame: str = "image") -> DataFrame:
    """For each detection the keypoint instance whose box centre is nearest.

    ``detections``: key, x1…y2 and the crop offset ``off_x, off_y``;
    ``instances``: key, ``pos`` and the box ``kx1…ky2`` in crop space. With
    ``frame="crop"`` the two frames are compared as they are, without the offset.
    """
    sign = 1 if frame == "image" else 0
    dx = (c("kx1") + c("kx2")) / 2 + c("off_x") * sign - (c("x1") + c("x2")) / 2
    dy = (c("ky1") + c("ky2")) / 2 + c("off_y") * sign - (c("y1") + c("y2")) / 2
    pairs = detections.join(instances, key).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    best = F.min(F.struct("distance", "pos")).alias("_best")
    return pairs.groupBy(key).agg(best).select(key, c("_best.pos").alias("pos"), c("_best.distance").alias("distance"))


def filter_confident_target(detections: DataFrame, target: str = "dog", threshold: float = 0.5) -> DataFrame:
    """Detections of the target class (a missing class counts) with enough confidence."""
    same = F.coalesce(c("class"), F.lit(target)) == target
    return detections.filter(same & (c("confidence") >= threshold))


def best_detection(detections: DataFrame, key: str = "image_id", tie: str = "ann_key") -> DataFrame:
    """Most confident detection per image; the smaller ``tie`` wins a draw.

    A plain aggregate, so one image with very many detections is combined on
    the map side.
    """
    rest = [k for k in detections.columns if k not in {key, "confidence", tie}]
    order = F.struct((-c("confidence")).alias("_neg"), c(tie).alias(tie))
    row = F.struct("confidence", tie, *rest)
    best = detections.groupBy(key).agg(F.min_by(row, order).alias("_best"))
    return best.select(key, "_best.*")


def classify_image(images: DataFrame, detections: DataFrame, threshold: float = 0.5,
                   key: str = "image_id", tie: str = "ann_key") -> DataFrame:
    """Class of the most confident detection of any class, else ``no_animal``."""
    best = best_detection(detections, key, tie).select(key, "confidence", c("class").alias("_class"))
    sure = F.coalesce(c("confidence") >= threshold, F.lit(False))
    label = F.when(sure, F.coalesce(c("_class"), F.lit("other"))).otherwise(F.lit("no_animal"))
    return images.join(best, key, "left").select(key, label.alias("animal_class"))
