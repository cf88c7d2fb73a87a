"""Detector quality: IoU matching, precision/recall curve, average precision.

Matching per image: each prediction takes the ground-truth box it overlaps
most (smallest key on a draw); each ground-truth box then accepts, per IoU level,
its most confident taker. Both steps are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelage.functions.geometry import iou
from pelage.operators.prefix import positions, running
from pelage.session import materialize

c = F.col

# The usual IoU grid and the number of recall points.
IOU_LEVELS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
RECALL_POINTS = 101

# Predictions x boxes of one image from which on it is cut into cells.
LARGE_IMAGE_PAIRS = 1_000_000
_CORNERS = ("x1", "y1", "x2", "y2")


def _cells(size: Column, centre: Column, reach: bool) -> Column:
    """(size class, place) codes along one axis.

    Boxes with IoU >= 0.5 differ by at most a factor 2 in each side, and their
    centres by at most half of the smaller one's double. With size classes of a
    factor 4 and places of that length, a ground-truth box that is entered
    under every class and place in reach meets each of its possible partners.
    """
    def level(s: Column) -> Column:
        return F.floor(F.log2(F.greatest(s, F.lit(2.0 ** -20))) / 2).cast("int")

    def length(k: Column) -> Column:
        return F.pow(F.lit(4.0), k + 1)

    if not reach:
        k = level(size)
        place = F.floor(centre / length(k)).cast("long")
        return F.array(F.struct(k.alias("k"), place.alias("p")))
    levels = F.sequence(level(size / 2), level(size * 2))
    return F.flatten(F.transform(levels, lambda k: F.transform(
        F.sequence(
            F.floor((centre - size) / length(k)).cast("long"),
            F.floor((centre + size) / length(k)).cast("long")),
        lambda p: F.struct(k.alias("k"), p.alias("p")))))


def _with_cells(df: DataFrame, reach: bool) -> DataFrame:
    """Adds ``cell``: one for an ordinary image, several for a large one."""
    width, height = c("x2") - c("x1"), c("y2") - c("y1")
    xs = _cells(width.cast("double"), (c("x1") + c("x2")) / 2, reach)
    ys = _cells(height.cast("double"), (c("y1") + c("y2")) / 2, reach)
    both = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.xxhash64(x, y))))
    cells = F.when(c("_large"), F.array_distinct(both)).otherwise(F.array(F.lit(0).cast("long")))
    return df.withColumn("cell", F.explode(cells))


# Factors that put an overlap (to 1e-15) and a box number into one sortable decimal of 34 digits.
_OVERLAP, _NUMBERS = 10 ** 15, 10 ** 18


def _stored(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides written once; ``gt_number`` stands for the order of the boxes' keys."""
    asked = materialize(predictions.select("pred_key", "image_id", *_CORNERS, "confidence"), "predictions")
    return asked, positions(truth.select("gt_key", "image_id", *_CORNERS), ["gt_key"], "gt_number")


def _matched(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``pred_key, confidence, gt_number, iou`` of stored sides.

    Overlap and tie make one fixed-width number, so that the best box of a
    prediction is found by hash aggregates, combined before the shuffle.
    """
    boxes = truth.groupBy("image_id", *_CORNERS).agg(F.min("gt_number").alias("gt_number"))
    load = predictions.groupBy("image_id").agg(F.count("*").alias("_a")).join(
        truth.groupBy("image_id").agg(F.count("*").alias("_b")), "image_id")
    large = load.filter(c("_a") * c("_b") > LARGE_IMAGE_PAIRS).select("image_id", F.lit(True).alias("_large"))

    def side(df: DataFrame, reach: bool) -> DataFrame:
        marked = df.join(large, "image_id", "left").withColumn("_large", F.coalesce(c("_large"), F.lit(False)))
        return _with_cells(marked, reach)

    corners = F.struct(*_CORNERS)
    left = side(predictions, False)
    right = side(boxes, True).select("image_id", "cell", corners.alias("g"), "gt_number")
    overlaps = left.select("pred_key", "confidence", "image_id", "cell", corners.alias("p")).join(
        right, ["image_id", "cell"]).withColumn("iou", iou(c("p"), c("g"))).filter(c("iou") >= IOU_LEVELS[0])
    score = F.round(c("iou") * _OVERLAP).cast("decimal(16,0)") * F.lit(_NUMBERS).cast("decimal(19,0)")
    order = score + F.lit(_NUMBERS - 1).cast("decimal(18,0)") - c("gt_number").cast("decimal(18,0)")
    return overlaps.groupBy("pred_key").agg(
        F.max("confidence").alias("confidence"), F.max_by("gt_number", order).alias("gt_number"), F.max_by("iou", order).alias("iou"))


def match_boxes(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``pred_key, confidence, gt_key, iou``: the most overlapped box (IoU >= 0.5) of each prediction.

    Equal ground-truth boxes of an image count as one with the smallest key;
    overlaps that agree to 1e-15 are a draw, which the smallest key wins. An
    image with very many pairs is joined cell by cell, so that only boxes of
    about the same place and size meet.
    """
    asked, known = _stored(predictions, truth)
    return _matched(asked, known).join(known.select("gt_number", "gt_key"), "gt_number").select(
        "pred_key", "confidence", "gt_key", "iou")


def _hits(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``level, confidence`` of the true positives, of stored sides."""
    levels = F.filter(F.array(*[F.lit(v) for v in IOU_LEVELS]), lambda v: v <= c("iou"))
    return _matched(predictions, truth).withColumn("level", F.explode(levels)).groupBy("gt_number", "level").agg(
        F.max("confidence").alias("confidence")).select("level", "confidence")


def precision_recall_curve(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``level, confidence, precision, recall`` at each distinct confidence.

    The sums along the curve are taken in ranges of confidence, so a curve may
    have as many points as there are predictions.
    """
    predictions, truth = _stored(predictions, truth)
    per_conf = predictions.groupBy("confidence").agg(F.count("*").alias("n"))
    tp = _hits(predictions, truth).groupBy("level", "confidence").agg(F.count("*").alias("tp"))
    grid = per_conf.withColumn("level", F.explode(F.array(*[F.lit(v) for v in IOU_LEVELS])))
    points = materialize(
        grid.join(tp, ["level", "confidence"], "left").fillna(0, ["tp"]).withColumn("down", -c("confidence")), "curve-points")
    total = truth.agg(F.count("*")).scalar()
    cumulative = running(points, ["level"], ["down"], {"_tp": ("sum", c("tp")), "_n": ("sum", c("n"))})
    recall = F.when(total > 0, c("_tp") / total).otherwise(F.lit(0.0))
    return cumulative.select(
        "level", "confidence", (c("_tp") / c("_n")).alias("precision"), recall.alias("recall"))


def average_precision_per_level(curve: DataFrame) -> DataFrame:
    """``level, ap``: trapezoid area of the precision envelope at 101 recall points."""
    # The curve starts at precision 1 and drops to 0 behind its last recall. Along
    # falling confidence recall rises and the envelope falls, so the point before
    # has the largest recall and the smallest envelope so far.
    envelope = running(curve, ["level"], ["confidence"], {"p": ("max", c("precision"))})
    before = running(envelope, ["level"], [c("confidence").desc()],
                     {"r0": ("max", c("recall")), "q0": ("max", -c("p"))}, inclusive=False)
    steps = before.select(
        "level", c("recall").alias("r"), "p", F.coalesce("r0", F.lit(0.0)).alias("r0"),
        F.coalesce(-c("q0"), F.lit(1.0)).alias("p0"))
    last = envelope.groupBy("level").agg(F.max("recall").alias("r0"), F.min_by("p", "confidence").alias("p0"))
    tail = last.select("level", F.lit(1.0).alias("r"), F.lit(0.0).alias("p"), "r0", "p0")
    segments = steps.unionByName(tail)
    n = RECALL_POINTS - 1
    # Points in [r0, r): a point on a step takes the value behind it, and recall 1 counts 0.
    first, end = F.ceil(c("r0") * n - 1e-9).cast("int"), F.ceil(c("r") * n - 1e-9).cast("int") - 1
    index = F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))
    at = segments.filter(c("r") > c("r0")).withColumn("i", F.explode(index))
    value = c("p0") + (c("i") / n - c("r0")) / (c("r") - c("r0")) * (c("p") - c("p0"))
    weighted = F.when(c("i") == 0, value / 2).otherwise(value)
    return at.groupBy("level").agg((F.sum(weighted) / n).alias("ap"))


def detection_eval(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mAP50, mAP50-95, and precision and recall at the best F1 (IoU 0.5).

    ``predictions``: pred_key, image_id, x1…y2, confidence; ``truth``: gt_key, image_id, x1…y2.
    """
    # Used twice below and small: written once.
    curve = materialize(precision_recall_curve(predictions, truth), "precision-recall")
    ap = average_precision_per_level(curve)
    quality = ap.agg(
        F.max(F.when(c("level") == IOU_LEVELS[0], c("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    f1 = 2 * c("precision") * c("recall") / (c("precision") + c("recall") + F.lit(1e-16))
    best = curve.filter(c("level") == IOU_LEVELS[0]).agg(
        F.max_by(F.struct("precision", "recall"), F.struct(f1, "confidence")).alias("_b"))
    best = best.select("_b").scalar()
    return quality.select(
        "map50", "map50_95", best["precision"].alias("precision"), best["recall"].alias("recall"))
