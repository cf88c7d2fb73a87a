"""Box and keypoint rules on single rows with known answers."""

import pytest
from pyspark.sql import functions as F

from pelage.functions import geometry as G
from pelage.operators import boxes as B
from pelage.operators.inference import most_confident, scale_raw_detections, scale_raw_keypoints


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def row(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def test_voc_corners(spark):
    df = row(spark, xmin=25.0, ymin=10.0, xmax=276.0, ymax=498.0, width=333, height=500)
    assert tuple(one(B.voc_box_clean(df).select("x", "y", "w", "h"))) == (25.0, 10.0, 251.0, 488.0)


@pytest.mark.parametrize("box", [(400.0, 10.0, 20.0, 20.0), (10.0, 10.0, 0.0, 5.0), (-30.0, 0.0, 20.0, 20.0)])
def test_boxes_without_area_go(spark, box):
    df = row(spark, **dict(zip("xywh", box)), width=333, height=500)
    assert B.coco_box_clean(df).count() == 0
    assert B.yolo_box(df).count() == 0


def test_unknown_coordinate_is_no_box(spark):
    df = spark.createDataFrame([(None, 1.0, 9.0, 9.0, 20, 20)], "xmin double, ymin double, xmax double, ymax double, width int, height int")
    assert B.voc_box_clean(df).count() == 0


def test_three_clamps_differ(spark):
    df = row(spark, x=-10.0, y=5.0, w=30.0, h=20.0, width=100, height=100)
    assert one(B.coco_box_clean(df)).w == 20.0
    assert one(B.keypoint_crop(df)).w == 30
    assert one(B.pose_box(df)).xc == pytest.approx(0.05)


def test_keypoint_crop_pads_each_axis(spark):
    df = row(spark, x=50.0, y=50.0, w=100.0, h=100.0, width=200, height=200)
    r = one(B.keypoint_crop(df, padding=0.1))
    assert (r.crop_w, r.crop_h) == (120, 120)
    assert (r.x, r.y, r.w, r.h, r.area) == (10, 10, 100, 100, 10000)


def test_joint_selection_moves_and_blanks(spark):
    joints = [[0.0, 0.0, 0.0]] * 24
    joints[16], joints[17], joints[14], joints[15] = [100.0, 100.0, 1.0], [100.0, 120.0, 1.0], [80.0, 80.0, 1.0], [120.0, 80.0, 0.0]
    df = spark.createDataFrame([(joints,), (joints[:15],)], "joints array<array<double>>")
    found = [[tuple(k) for k in r[0]] for r in df.select(G.select_joints(F.col("joints"), F.lit(50), F.lit(50))).collect()]
    assert found[0] == [(50, 50, 1), (50, 70, 1), (30, 30, 1), (0, 0, 0)]
    assert found[1] == [(0, 0, 0), (0, 0, 0), (30, 30, 1), (0, 0, 0)]


def test_validation_blanks_outside_only(spark):
    points = [(10.0, 10.0, 1.0), (150.0, 10.0, 1.0), (10.0, 150.0, 1.0), (-10.0, 5.0, 1.0), (50.0, 50.0, 0.0)]
    df = spark.createDataFrame([(points,)], f"k {G.KEYPOINT_TYPE}")
    checked = G.validate_keypoints(F.col("k"), F.lit(100), F.lit(100))
    r = one(df.select(checked.alias("k"), G.count_visible(checked).alias("n")))
    assert [tuple(k) for k in r.k] == [(10, 10, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (50, 50, 0)]
    assert r.n == 1


def test_keypoint_text(spark):
    df = spark.createDataFrame([([(50.0, 25.0, 1.0)],), ([],)], f"k {G.KEYPOINT_TYPE}")
    text = G.keypoint_text(G.normalized_keypoints(F.col("k"), G.count_visible(F.col("k")), F.lit(100), F.lit(50)))
    assert [r[0] for r in df.select(text).collect()] == [" 0.500000 0.500000 2", " 0" * 12]


def test_raw_detections_scale_and_drop(spark):
    raw = [[100.0, 150.0, 200.0, 250.0, 0.9, 0.0], [0.0, 0.0, 1.0, 1.0, 0.05, 0.0]]
    df = spark.createDataFrame([(raw,)], "raw array<array<double>>")
    found = one(df.select(scale_raw_detections(F.col("raw"), F.lit(1200), F.lit(800), 640, 640).alias("d"))).d
    assert [(d.x1, d.y1, d.x2, d.y2) for d in found] == [(187, 187, 375, 312)]


def test_raw_keypoints_scale_and_skip(spark):
    raw = [[0.0] * 4 + [0.8, 0.0] + [50.0, 60.0, 0.99] * 4, [1.0, 2.0]]
    df = spark.createDataFrame([(raw,)], "raw array<array<double>>")
    found = one(df.select(scale_raw_keypoints(F.col("raw"), F.lit(400), F.lit(300), 640, 640).alias("k"))).k
    assert len(found) == 1
    assert tuple(found[0].keypoints[0]) == (31.25, 28.125, 0.99)


def test_most_confident_takes_the_first(spark):
    df = spark.createDataFrame([([(0.9, 0), (0.9, 1), (0.2, 2)],), ([],)], "d array<struct<confidence:double,pos:int>>")
    assert [r[0].pos if r[0] else None for r in df.select(most_confident(F.col("d"))).collect()] == [0, None]


@pytest.mark.parametrize("confidence, size", [(1.0, 20), (0.2, 80)])
def test_refinement_needs_all_keypoints(spark, confidence, size):
    points = [(40.0, 40.0, 1.0), (60.0, 60.0, confidence)]
    df = spark.createDataFrame([(points, 80, 80)], f"keypoints {G.KEYPOINT_TYPE}, crop_w long, crop_h long")
    r = one(B.keypoint_refine_crop(df, padding=0.0))
    assert r.final_x2 - r.final_x1 == size


def test_closest_instance_frames(spark):
    detections = spark.createDataFrame([(1, 100, 100, 120, 120, 90, 90)], "k int, x1 int, y1 int, x2 int, y2 int, off_x int, off_y int")
    instances = spark.createDataFrame([(1, 0, 10, 10, 30, 30), (1, 1, 100, 100, 120, 120)], "k int, pos int, kx1 int, ky1 int, kx2 int, ky2 int")
    assert one(B.closest_instance(detections, instances, "k")).pos == 0
    assert one(B.closest_instance(detections, instances, "k", frame="crop")).pos == 1


def test_window_outside_of_image_is_null(spark):
    df = row(spark, x1=300, y1=10, x2=310, y2=20, width=200, height=200)
    assert one(B.detection_crop(df)).crop_x1 is None


def test_confident_target_counts_missing_class(spark):
    df = spark.createDataFrame([("a", "dog", 0.9), ("b", None, 0.5), ("c", "cat", 0.9), ("d", "dog", 0.4)], "id string, class string, confidence double")
    assert {r.id for r in B.filter_confident_target(df).collect()} == {"a", "b"}
