"""Batch scoring with injected models.

A model is given as ``load() -> predict``: ``load`` runs once per task, and
``predict(list of RGB arrays)`` answers once per Arrow batch. Images are rows
with the fields of Spark's image source (``height, width, nChannels, data``).
Pixels go to Python and never through a shuffle: detections, crops and
keypoints are array columns of the image row, and all geometry between the
models is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelage.functions import geometry as G

c = F.col

Predict = Callable[[list[np.ndarray]], list]
Load = Callable[[], Predict]

RAW_DETECTIONS = "array<array<double>>"
RAW_KEYPOINTS = "array<array<double>>"

# Classes a detector may report.
ANIMAL_CLASSES = ("no_animal", "dog", "cat", "bird", "other")

_PIXELS = ("height", "width", "nChannels", "data")


def rgb_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Row of the image source (BGR bytes) to an RGB array."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return pixels[:, :, ::-1] if channels == 3 else pixels


def to_model_input(image: np.ndarray) -> np.ndarray:
    """Height x width x channel bytes to channel-first floats in [0, 1]."""
    return np.transpose(image.astype(np.float32) / 255.0, (2, 0, 1))


def _predict_column(load: Load, return_type: str, window: Column | None = None) -> Column:
    """Model output as a column; NULL for an image without pixels, and where ``window`` is given and NULL."""
    def answers(rows: pd.DataFrame, predict: Predict) -> pd.Series:
        wanted = rows["height"].notna() & (rows["x1"].notna() if "x1" in rows else True)
        asked = np.flatnonzero(wanted)
        images = []
        for i in asked:
            row = rows.iloc[i]
            image = rgb_array(int(row["height"]), int(row["width"]), int(row["nChannels"]), row["data"])
            if "x1" in rows:
                image = image[int(row["y1"]):int(row["y2"]), int(row["x1"]):int(row["x2"])]
            images.append(image)
        out: list = [None] * len(rows)
        for i, answer in zip(asked, predict(images) if images else []):
            out[i] = answer
        return pd.Series(out, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = load()
        for rows in batches:
            yield answers(rows, predict)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    # Not deterministic for the optimizer: model output is computed once per row and
    # never copied into the expressions that use it.
    model = F.pandas_udf(run, return_type).asNondeterministic()
    fields = [c(k) for k in _PIXELS]
    if window is not None:
        fields += [window[k].alias(k) for k in ("x1", "y1", "x2", "y2")]
    return model(F.struct(*fields))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: the optimizer would copy a
    plain expression into each of its uses, and windows of windows explode. NULL stays NULL."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), body(v))), 0)


def scale_raw_detections(raw: Column, width: Column, height: Column, input_w: int, input_h: int,
                         floor: float = 0.1, animal_class: str = "dog") -> Column:
    """Raw rows ``x1, y1, x2, y2, confidence, …`` to detections in image pixels."""
    kept = F.filter(raw, lambda d: F.get(d, 4) >= floor)

    def corner(d: Column, i: int) -> Column:
        size, full = (input_w, width) if i % 2 == 0 else (input_h, height)
        return G.truncate(F.get(d, i) * full / F.lit(float(size)))

    return F.transform(kept, lambda d, i: F.struct(
        corner(d, 0).alias("x1"), corner(d, 1).alias("y1"), corner(d, 2).alias("x2"), corner(d, 3).alias("y2"),
        F.get(d, 4).alias("confidence"), F.lit(animal_class).alias("class"), i.alias("pos")))


def scale_raw_keypoints(raw: Column, crop_w: Column, crop_h: Column, input_w: int, input_h: int) -> Column:
    """Raw rows to ``STRUCT<keypoints, confidence, pos>`` in crop pixels.

    A row has the confidence at 4 and x, y, v of four keypoints from 6 on;
    rows of fewer than 7 values are skipped.
    """
    kept = F.filter(raw, lambda d: F.size(d) >= 7)

    def point(d: Column, k: Column) -> Column:
        at = k * 3 + 6
        return F.struct(
            (F.get(d, at) * crop_w / F.lit(float(input_w))).alias("x"),
            (F.get(d, at + 1) * crop_h / F.lit(float(input_h))).alias("y"),
            F.get(d, at + 2).alias("v"))

    return F.transform(kept, lambda d, i: F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: point(d, k)).alias("keypoints"),
        F.get(d, 4).alias("confidence"), i.alias("pos")))


def most_confident(detections: Column) -> Column:
    """First of the most confident elements; NULL for an empty list."""
    ranked = F.transform(detections, lambda d: F.struct(
        d["confidence"].alias("a"), (-d["pos"]).alias("b"), d.alias("d")))
    return F.array_max(ranked)["d"]


def confident_targets(detections: Column, target: str = "dog", threshold: float = 0.5) -> Column:
    return F.filter(detections, lambda d: (F.coalesce(d["class"], F.lit(target)) == target) & (
        d["confidence"] >= threshold))


def detect_batch(images: DataFrame, load: Load, input_size: tuple[int, int] = (640, 640),
                 floor: float = 0.1, animal_class: str = "dog") -> DataFrame:
    """Adds ``detections``, all above the confidence floor, in image pixels."""
    raw = images.withColumn("_raw", _predict_column(load, RAW_DETECTIONS))
    found = scale_raw_detections(
        c("_raw"), c("width"), c("height"), input_size[0], input_size[1], floor, animal_class)
    return raw.withColumn("detections", found).drop("_raw")


def keypoints_batch(crops: DataFrame, load: Load, window: str = "crop",
                    input_size: tuple[int, int] = (640, 640)) -> DataFrame:
    """Adds ``instances``: keypoint detections inside the window, in crop pixels."""
    w = c(window)
    raw = crops.withColumn("_raw", _predict_column(load, RAW_KEYPOINTS, w))
    found = scale_raw_keypoints(c("_raw"), w.x2 - w.x1, w.y2 - w.y1, input_size[0], input_size[1])
    return raw.withColumn("instances", found).drop("_raw")


def embed_batch(crops: DataFrame, load: Load, window: str = "crop") -> DataFrame:
    """Adds ``embedding`` of the window; NULL where the window is NULL."""
    return crops.withColumn("embedding", _predict_column(load, "array<float>", c(window)))


def score_images(
    images: DataFrame, detector: Load, embedder: Load, keypoint_model: Load | None = None, *,
    target: str = "dog", detection_threshold: float = 0.5, keypoint_threshold: float = 0.3,
    detector_size: tuple[int, int] = (640, 640), keypoint_size: tuple[int, int] = (640, 640),
) -> DataFrame:
    """Detect, keep the best target, crop, refine (optional), embed.

    Adds ``crop`` (window in the image) and ``embedding``; both NULL where any
    stage finds nothing.
    """
    df = detect_batch(images, detector, detector_size, animal_class=target)
    best = most_confident(confident_targets(c("detections"), target, detection_threshold))
    df = df.withColumn("crop", _let(best, lambda b: G.detection_window(
        b["x1"], b["y1"], b["x2"], b["y2"], c("width"), c("height"))))
    if keypoint_model is not None:
        df = keypoints_batch(df, keypoint_model, "crop", keypoint_size)

        def inside(crop: Column, points: Column) -> Column:
            fine = G.refined_window(points, crop["x2"] - crop["x1"], crop["y2"] - crop["y1"], keypoint_threshold)
            return _let(fine, lambda f: F.when(f.isNotNull(), F.struct(
                (crop["x1"] + f["x1"]).alias("x1"), (crop["y1"] + f["y1"]).alias("y1"),
                (crop["x1"] + f["x2"]).alias("x2"), (crop["y1"] + f["y2"]).alias("y2"))))

        stage = F.struct(c("crop").alias("crop"), most_confident(c("instances"))["keypoints"].alias("points"))
        refined = _let(stage, lambda s: inside(s["crop"], s["points"]))
        df = df.withColumn("crop", F.when(c("crop").isNotNull(), refined)).drop("instances")
    return embed_batch(df, embedder, "crop")


def build_gallery(scored: DataFrame, key: str = "image_id") -> DataFrame:
    """Scored images that have an embedding, without their pixels."""
    return scored.filter(c("embedding").isNotNull()).select(key, "embedding")


def classify_images(images: DataFrame, detector: Load, threshold: float = 0.5,
                    input_size: tuple[int, int] = (640, 640)) -> DataFrame:
    """Adds ``animal_class`` of the most confident detection, ``no_animal`` below the threshold."""
    df = detect_batch(images, detector, input_size)
    best = most_confident(c("detections"))
    sure = F.coalesce(best["confidence"] >= threshold, F.lit(False))
    return df.withColumn("animal_class", F.when(sure, F.coalesce(best["class"], F.lit("other"))).otherwise(
        F.lit("no_animal")))


def two_stage_inference(
    images: DataFrame, detector: Load, keypoint_model: Load, *, confidence: float = 0.5, padding: float = 0.2,
    detector_size: tuple[int, int] = (640, 640), keypoint_size: tuple[int, int] = (640, 640),
    frame: str = "image", key: str = "image_id",
) -> DataFrame:
    """Keypoints of every confident detection, in image coordinates.

    One row per detection: ``key, pos, x1…y2, confidence, crop, keypoints``. Of
    several keypoint instances in a crop the one nearest to the detection is
    kept (see ``closest_instance`` for ``frame``).
    """
    found = detect_batch(images, detector, detector_size)
    each = found.withColumn("d", F.explode(F.filter("detections", lambda d: d["confidence"] >= confidence)))
    d = c("d")
    each = each.withColumn("crop", G.per_axis_window(d.x1, d.y1, d.x2, d.y2, c("width"), c("height"), padding))
    each = keypoints_batch(each, keypoint_model, "crop", keypoint_size)
    crop, off = c("crop"), 1 if frame == "image" else 0

    def middle(points: Column, axis: str) -> Column:
        values = F.transform(points, lambda k: k[axis])
        return (F.array_min(values) + F.array_max(values)) / 2

    def distance(i: Column) -> Column:
        dx = middle(i["keypoints"], "x") + crop.x1 * off - (d.x1 + d.x2) / 2
        dy = middle(i["keypoints"], "y") + crop.y1 * off - (d.y1 + d.y2) / 2
        return F.sqrt(dx * dx + dy * dy)

    ranked = F.transform("instances", lambda i: F.struct(
        distance(i).alias("a"), i["pos"].alias("b"), i["keypoints"].alias("k")))
    nearest = F.array_min(ranked)["k"]
    return each.select(
        key, d.pos.alias("pos"), d.x1.alias("x1"), d.y1.alias("y1"), d.x2.alias("x2"), d.y2.alias("y2"),
        d.confidence.alias("confidence"), "crop",
        G.uncrop_keypoints(nearest, crop.x1, crop.y1).alias("keypoints"))
