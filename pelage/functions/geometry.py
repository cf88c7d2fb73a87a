"""Box and keypoint geometry as column expressions (all stay in whole-stage codegen).

Boxes are either ``x, y, w, h`` (annotation side) or ``x1, y1, x2, y2``
(detector side). Keypoints are ``ARRAY<STRUCT<x, y, v>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYPOINT_TYPE = "array<struct<x:double,y:double,v:double>>"

# Joints kept from the 24-joint source skeleton, in output order.
JOINT_INDEX = {"nose": 16, "chin": 17, "left_ear_base": 14, "right_ear_base": 15}
# Fixed value: index of each keypoint after a horizontal flip.
FLIP_INDEX = [0, 1, 3, 2]


def truncate(value: Column) -> Column:
    """Toward zero, as an integer cast of a double."""
    return value.cast("double").cast("bigint")


def _known(value: Column, *needed: Column) -> Column:
    """``value`` where all ``needed`` are known: ``greatest`` and ``least`` skip NULLs."""
    known = needed[0].isNotNull()
    for column in needed[1:]:
        known &= column.isNotNull()
    return F.when(known, value)


def _non_negative(value: Column) -> Column:
    return F.greatest(F.lit(0), value)


# ---- annotation boxes -------------------------------------------------------

def clean_corners(xmin: Column, ymin: Column, xmax: Column, ymax: Column,
                  width: Column, height: Column) -> Column:
    """Corners clamped to the image, as ``STRUCT<x, y, w, h>`` with two decimals.

    The box shrinks when a corner lies outside.
    """
    left, top = F.greatest(F.lit(0.0), xmin), F.greatest(F.lit(0.0), ymin)
    right = F.least(width.cast("double"), xmax)
    bottom = F.least(height.cast("double"), ymax)
    return _known(F.struct(
        F.round(left, 2).alias("x"),
        F.round(top, 2).alias("y"),
        F.round(right - left, 2).alias("w"),
        F.round(bottom - top, 2).alias("h"),
    ), xmin, ymin, xmax, ymax, width, height)


def clean_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Same for a box given as corner plus size."""
    return clean_corners(x, y, x + w, y + h, width, height)


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Box cut at the image border, not rounded."""
    left, top = _non_negative(x), _non_negative(y)
    return _known(F.struct(
        left.cast("double").alias("x"),
        top.cast("double").alias("y"),
        (F.least(width, x + w) - left).cast("double").alias("w"),
        (F.least(height, y + h) - top).cast("double").alias("h"),
    ), x, y, w, h, width, height)


def centre_form(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre and size relative to the image."""
    return F.struct(
        ((x + w / 2) / width).alias("xc"),
        ((y + h / 2) / height).alias("yc"),
        (w / width).alias("w"),
        (h / height).alias("h"),
    )


def pixel_corners(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Inverse of :func:`centre_form`: integer corners."""
    return F.struct(
        truncate((xc - w / 2) * width).alias("x1"),
        truncate((yc - h / 2) * height).alias("y1"),
        truncate((xc + w / 2) * width).alias("x2"),
        truncate((yc + h / 2) * height).alias("y2"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two ``STRUCT<x1, y1, x2, y2>``."""
    iw = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    ih = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    inter = iw * ih
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


# ---- crop windows -----------------------------------------------------------

def window_around(x1: Column, y1: Column, x2: Column, y2: Column,
                  pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """Padded window clamped to ``width`` x ``height``; NULL when nothing is left."""
    window = F.struct(
        _non_negative(x1 - pad_x).cast("bigint").alias("x1"),
        _non_negative(y1 - pad_y).cast("bigint").alias("y1"),
        F.least(width, x2 + pad_x).cast("bigint").alias("x2"),
        F.least(height, y2 + pad_y).cast("bigint").alias("y2"),
    )
    return _known(F.when((window.x2 > window.x1) & (window.y2 > window.y1), window), x1, y1, x2, y2, width, height)


def detection_window(x1: Column, y1: Column, x2: Column, y2: Column,
                     width: Column, height: Column, padding: float = 0.1) -> Column:
    """Crop around a detection; the pad follows the box width on both axes."""
    pad = truncate((x2 - x1) * F.lit(padding))
    return window_around(x1, y1, x2, y2, pad, pad, width, height)


def per_axis_window(x1: Column, y1: Column, x2: Column, y2: Column,
                    width: Column, height: Column, padding: float = 0.2) -> Column:
    """Crop padded by a share of each side."""
    return window_around(
        x1, y1, x2, y2,
        truncate((x2 - x1) * F.lit(padding)), truncate((y2 - y1) * F.lit(padding)),
        width, height,
    )


def refined_window(keypoints: Column, crop_w: Column, crop_h: Column,
                   threshold: float = 0.3, padding: float = 0.2) -> Column:
    """Window of the keypoints inside a crop, if all are seen with confidence.

    NULL ``keypoints`` or any unsure keypoint keep the whole crop; a refined
    window with no area is NULL.
    """
    xs = F.transform(keypoints, lambda k: k["x"])
    ys = F.transform(keypoints, lambda k: k["y"])
    kx1, ky1 = truncate(F.array_min(xs)), truncate(F.array_min(ys))
    kx2, ky2 = truncate(F.array_max(xs)), truncate(F.array_max(ys))
    pad = truncate((kx2 - kx1) * F.lit(padding))
    sure = (F.size(keypoints) > 0) & F.forall(keypoints, lambda k: k["v"] > threshold)
    whole = window_around(F.lit(0), F.lit(0), crop_w, crop_h, F.lit(0), F.lit(0), crop_w, crop_h)
    return F.when(
        F.coalesce(sure, F.lit(False)),
        window_around(kx1, ky1, kx2, ky2, pad, pad, crop_w, crop_h),
    ).otherwise(whole)


# ---- keypoints --------------------------------------------------------------

def select_joints(joints: Column, x_offset: Column, y_offset: Column) -> Column:
    """The four kept joints of ``ARRAY<ARRAY<DOUBLE>>``, moved into crop space.

    A joint that is missing or not visible becomes (0, 0, 0).
    """
    def pick(index: Column) -> Column:
        joint = F.get(joints, index)
        visible = F.coalesce(F.get(joint, 2) > 0, F.lit(False))
        return F.struct(
            F.when(visible, F.get(joint, 0) - x_offset).otherwise(F.lit(0.0)).alias("x"),
            F.when(visible, F.get(joint, 1) - y_offset).otherwise(F.lit(0.0)).alias("y"),
            F.when(visible, F.get(joint, 2)).otherwise(F.lit(0.0)).alias("v"),
        )

    return F.transform(F.array(*[F.lit(i) for i in JOINT_INDEX.values()]), pick)


def validate_keypoints(keypoints: Column, width: Column, height: Column) -> Column:
    """Visible keypoints outside the image become (0, 0, 0); invisible ones stay."""
    def check(k: Column) -> Column:
        inside = (k["x"] >= 0) & (k["x"] < width) & (k["y"] >= 0) & (k["y"] < height)
        gone = (k["v"] > 0) & ~inside
        return F.struct(*[F.when(gone, F.lit(0.0)).otherwise(k[p]).alias(p) for p in ("x", "y", "v")])

    return F.transform(keypoints, check)


def count_visible(keypoints: Column) -> Column:
    return F.size(F.filter(keypoints, lambda k: k["v"] > 0)).cast("bigint")


def normalized_keypoints(keypoints: Column, num_keypoints: Column, width: Column, height: Column) -> Column:
    """Keypoints relative to the image, visibility 0 or 2; NULL when there is none to write."""
    scaled = F.transform(keypoints, lambda k: F.struct(
        (k["x"] / width).alias("x"),
        (k["y"] / height).alias("y"),
        F.when(k["v"] > 0, F.lit(2.0)).otherwise(k["v"]).alias("v"),
    ))
    return F.when((F.size(keypoints) > 0) & (F.coalesce(num_keypoints, F.lit(0)) > 0), scaled)


def keypoint_text(normalized: Column, count: int = 4) -> Column:
    """`` kx ky v`` per keypoint; zeros for all ``count`` when there is none."""
    words = F.transform(normalized, lambda k: F.format_string(
        " %.6f %.6f %d", k["x"], k["y"], k["v"].cast("int")))
    return F.coalesce(F.array_join(words, ""), F.lit(" 0" * (count * 3)))


def pixel_keypoints(keypoints: Column, width: Column, height: Column) -> Column:
    """Visible relative keypoints in integer pixels."""
    seen = F.filter(keypoints, lambda k: k["v"] > 0)
    return F.transform(seen, lambda k: F.struct(
        truncate(k["x"] * width).alias("x"), truncate(k["y"] * height).alias("y")))


def uncrop_keypoints(keypoints: Column, x_offset: Column, y_offset: Column) -> Column:
    """Crop coordinates to integer image coordinates."""
    return F.transform(keypoints, lambda k: F.struct(
        truncate(k["x"] + x_offset).alias("x"), truncate(k["y"] + y_offset).alias("y")))


def triples(flat: Column) -> Column:
    """``ARRAY<DOUBLE>`` x, y, v, x, y, v … to keypoint structs; a short tail is dropped."""
    n = F.floor(F.size(flat) / 3).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(
        F.get(flat, i * 3).alias("x"), F.get(flat, i * 3 + 1).alias("y"), F.get(flat, i * 3 + 2).alias("v")))
