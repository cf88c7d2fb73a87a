"""Splits, samples, evaluation sets, statistics and detector quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelage.functions import text as X
from pelage.operators import dataset as D
from pelage.operators import detection_eval as DE
from pelage.operators import prefix as P
from pelage.operators import splits as S
from pelage.operators import stats as T


@pytest.fixture(scope="module")
def folders(spark):
    """20 identities of 6 images; one of 3 is too small."""
    rows = [(i * 10 + k, f"id_{i:02d}", f"data/id_{i:02d}/{k}.jpg") for i in range(20) for k in range(6)]
    rows += [(900 + k, "small", f"data/small/{k}.jpg") for k in range(3)]
    return spark.createDataFrame(rows, "image_id long, identity string, file_path string")


def test_identity_split_is_disjoint_complete_and_stable(folders):
    first = {r.identity: r.split for r in S.identity_split(folders).collect()}
    again = {r.identity: r.split for r in S.identity_split(folders.repartition(7)).collect()}
    assert first == again
    assert len(first) == 20 and set(first.values()) == {"train", "val", "test"}
    assert sum(s == "test" for s in first.values()) == 3 == sum(s == "val" for s in first.values())
    joined = folders.join(S.identity_split(folders).select("identity", "split"), "identity")
    assert S.split_leakage(joined).count() == 0


def test_image_split_sizes_per_source(spark):
    images = spark.range(1000).select(F.col("id").alias("image_id"), F.when(F.col("id") < 333, "a").otherwise("b").alias("source"))
    counts = {(r.source, r.split): r["count"] for r in S.image_split(images).groupBy("source", "split").count().collect()}
    assert counts == {("a", "train"): 299, ("a", "val"): 34, ("b", "train"): 600, ("b", "val"): 67}


def test_dense_labels_follow_names(folders):
    labels = {r.identity: r.label for r in S.dense_label_ids(folders).collect()}
    assert labels == {name: i for i, name in enumerate(sorted(labels))}


def test_dense_labels_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "PARTS_PER_BLOCK", 3)
    names = spark.range(500).select(F.concat(F.lit("n"), (F.col("id") * 7919 % 500).cast("string")).alias("identity"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "false")
        labels = {r.identity: r.label for r in S.dense_label_ids(names).collect()}
    finally:
        spark.conf.set(setting, before)
    assert labels == {name: i for i, name in enumerate(sorted(labels))} and len(labels) == 500


def test_sequential_ids_are_contiguous_train_first(spark):
    boxes = spark.range(300).select(F.col("id").cast("string").alias("ann_key"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    rows = S.sequential_ids(boxes, "ann_key").orderBy("annotation_id").collect()
    assert [r.annotation_id for r in rows] == list(range(300))
    assert [r.split for r in rows] == ["train"] * 200 + ["val"] * 100


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_matches_plain_window(spark, monkeypatch, inclusive, coalesce):
    """Keys that cross sorted partitions and batches, a NULL key, columns named as helpers."""
    monkeypatch.setattr(P, "PARTS_PER_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(None if k == 3 else int(k), i, int(v), "own") for i, (k, v) in enumerate(zip(rng.integers(0, 4, 2000), rng.integers(-5, 50, 2000)))]
    df = spark.createDataFrame(rows, "k int, i int, v int, _part string").repartition(5)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {x: spark.conf.get(x) for x in settings}
    try:
        for x, y in settings.items():
            spark.conf.set(x, y)
        keyed = P.running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive).collect()
        whole = P.running(df, [], [F.col("i").desc()], {"s": ("sum", F.col("v")), "n": ("sum", F.lit(1))}, inclusive).collect()
        numbers = P.row_numbers(df, ["k"], -F.col("i"), [], "number").collect()
    finally:
        for x, y in before.items():
            spark.conf.set(x, y)
    assert len(keyed) == len(whole) == len(numbers) == 2000
    values = {}
    for k, i, v, _ in rows:
        values.setdefault(k, []).append((i, v))
    for r in keyed:
        mine = [v for i, v in values[r.k] if i < r.i or inclusive and i == r.i]
        assert r._part == "own" and r.s == sum(mine) and r.m == (max(mine) if mine else None)
    back = np.concatenate([[0], np.cumsum([v for _, _, v, _ in reversed(rows)])])
    for r in whole:
        n = 1999 - r.i + inclusive
        assert (r.n, r.s) == (n, back[n])
    for r in numbers:
        assert r.number == sum(i >= r.i for i, _ in values[r.k])


def test_partitions_of_a_sort_are_bounded_for_a_hot_key(spark, monkeypatch):
    """One key with most rows is numbered over many sorted partitions."""
    steps, write = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: steps.append(write(df, name)) or steps[-1])
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    before = {x: spark.conf.get(x, None) for x in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        written = P.running(rows, ["k"], ["id"], {"n": ("sum", F.lit(1))})
        parts = steps[0].groupBy("_part").count().collect()
        assert len(parts) >= 12 and max(r["count"] for r in parts) < 3 * 40_000 / 16
        assert written.filter("k = -1").agg(F.max("n")).first()[0] == 36_000
    finally:
        for x, y in before.items():
            spark.conf.set(x, y)


def test_caps_and_union_of_evaluation_set(spark):
    base = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "image_id long, identity string")
    extra = spark.createDataFrame([(10, "C"), (11, "C"), (12, "D")], "image_id long, identity string")
    assert S.augmented_eval_set(base, extra).count() == 6
    assert S.augmented_eval_set(base, extra, max_per_identity=1).count() == 4
    cut = S.augmented_eval_set(base, extra, num_images=4).collect()
    assert len(cut) == 4 and {10, 11, 12} <= {r.image_id for r in cut}
    assert len(S.augmented_eval_set(base, extra, num_images=2).collect()) == 2
    clash = base.withColumn("identity", F.lit("C"))
    assert {r.image_id for r in S.augmented_eval_set(clash, extra).collect()} == {10, 11, 12}
    assert [r.image_id for r in S.limit_per_identity(base, 1, "image_id").orderBy("image_id").collect()] == [1, 3]
    assert S.eval_set(base, 2).count() == 2 and S.eval_set(base, max_per_identity=1).count() == 2


def test_unlabelled_and_truthy(spark):
    df = spark.createDataFrame([("a",), ("0",), ("",), (None,)], "identity_label string")
    assert D.filter_unlabelled(df).count() == 3
    assert D.filter_unlabelled(df, truthy_labels=True).count() == 1


def test_category_lookup(spark):
    cats = spark.createDataFrame([(0, 18, "dog"), (1, 7, "dog"), (2, 1, "person")], "position int, id long, name string")
    boxes = spark.createDataFrame([(18,), (-1,), (1,)], "category_id long")
    assert D.category_lookup(cats).first().category_id == 18
    assert D.category_lookup(cats, "cat").first().category_id == -1
    assert D.target_boxes(boxes, cats).count() == 1
    assert D.target_boxes(boxes, cats, "cat").count() == 0


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_lists_have_one_layout_at_every_size(spark, size):
    """An image's boxes in order, ``size`` to a list, whatever their number; a column named as a helper's stays."""
    boxes = spark.range(140).select(
        F.when(F.col("id") < 100, 1).otherwise(F.col("id") - F.col("id") % 2).alias("image_id"),
        F.format_string("%03d", "id").alias("ann_key"), F.lit("own").alias("place")).repartition(5)
    want = {}
    for i in range(140):
        want.setdefault(1 if i < 100 else i - i % 2, []).append(f"{i:03d}")
    rows = D.annotations_per_image(boxes, size=size).collect()
    assert len(rows) == sum(-(-len(x) // size) for x in want.values())
    for r in rows:
        assert [b.ann_key for b in r.boxes] == want[r.image_id][r.part * size:(r.part + 1) * size] and r.n_boxes == len(r.boxes)
        assert {b.place for b in r.boxes} == {"own"}


def test_dedupe_keeps_the_first(spark):
    images = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "image_id long, file_name string")
    assert {(r.image_id, r.file_name) for r in D.dedupe_images(images).collect()} == {(1, "a"), (2, "b")}


def test_sources_are_tested_in_order(spark):
    paths = ["x/dogfacenet/coco/1", "oxford_pets/stanford_dogs/1", "additional_identities/1", "coco/1"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(
        X.source_bucket(F.col("p"), X.IDENTITY_SOURCES), X.source_bucket(F.col("p"), X.DETECTION_SOURCES)).collect()]
    assert got == [("DogFaceNet", "COCO"), ("Stanford Dogs", "Stanford Dogs"), ("Additional Identities", "Other"), ("Other", "COCO")]


def test_label_paths(spark):
    df = spark.createDataFrame([("a/images/images.v1/x.jpg",)], "p string")
    r = df.select(X.label_path(F.col("p")), X.label_path_all(F.col("p")), X.flat_label_name(F.col("p")),
                  X.crop_file_name(F.col("p"), F.lit(7))).first()
    assert tuple(r) == ("a/labels/images.v1/x.txt", "a/labels/images.v1/x.txt", "x.txt", "x_7.jpg")


def test_latest_run(spark):
    runs = spark.createDataFrame([("test_run1",), ("test_run2",), ("test_run10",), ("other_run5",), ("test_run_old",)], "name string")
    assert tuple(T.latest_run(runs, "test_run").first()) == ("test_run10", 10)
    assert T.latest_run(runs, "missing").count() == 0
    bare = spark.createDataFrame([("solo",)], "name string")
    assert tuple(T.latest_run(bare, "solo").first()) == ("solo", 0)


def brute_history(rows, patience):
    best, out, phases = -1.0, {}, {}
    for epoch, phase, score in rows:
        score = 0.0 if score is None else score
        state = phases.setdefault(phase, {"best": -1.0, "count": 0, "stopped": False})
        is_best, best = score > best, max(best, score)
        if score > state["best"]:
            state["best"], state["count"] = score, 0
        else:
            state["count"] += 1
        stop = state["count"] >= patience and not state["stopped"]
        state["stopped"] |= stop
        out[epoch] = (is_best, best, state["best"], state["count"], stop)
    return out


def test_training_history_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "HISTORY_CHUNK", 7)
    rng = np.random.default_rng(2)
    rows = [(e, "warmup" if e < 20 else "full", None if e == 4 else float(np.round(rng.uniform(-1.5, 1), 2))) for e in range(1, 90)]
    df = spark.createDataFrame([(1, *r) for r in rows], "run_id long, epoch int, phase string, map_score double")
    got = {r.epoch: (r.is_best, r.best_so_far, r.phase_best, r.patience_used, r.early_stop) for r in T.training_history(df, 5).collect()}
    assert got == brute_history(rows, 5)


def test_split_report_and_histogram(spark, folders):
    summary = T.identity_size_summary(folders).first()
    assert (summary.n_identities, summary.min_images, summary.max_images, summary.median_images) == (21, 3, 6, 6.0)


# ---- detector quality -------------------------------------------------------

def boxes_frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, image_id long, x1 double, y1 double, x2 double, y2 double"
                                 + (", confidence double" if key == "pred_key" else ""))


def test_perfect_detector(spark):
    truth = [(f"g{i}", i, 0.0, 0.0, 10.0 + i, 10.0) for i in range(5)]
    preds = [(f"p{i}", i, 0.0, 0.0, 10.0 + i, 10.0, 0.9 - i / 10) for i in range(5)]
    r = DE.detection_eval(boxes_frame(spark, preds, "pred_key"), boxes_frame(spark, truth, "gt_key")).first()
    assert r.precision == r.recall == 1.0
    assert (r.map50, r.map50_95) == pytest.approx((0.995, 0.995), abs=1e-9)


def test_each_box_accepts_its_most_confident_taker(spark):
    truth = [("g", 1, 0.0, 0.0, 10.0, 10.0)]
    preds = [("a", 1, 0.0, 0.0, 10.0, 10.0, 0.3), ("b", 1, 0.0, 0.0, 10.0, 9.0, 0.8), ("c", 2, 0.0, 0.0, 10.0, 10.0, 0.5)]
    curve = DE.precision_recall_curve(boxes_frame(spark, preds, "pred_key"), boxes_frame(spark, truth, "gt_key"))
    at = {(r.level, r.confidence): (r.precision, r.recall) for r in curve.collect()}
    assert at[0.5, 0.8] == (1.0, 1.0) and at[0.5, 0.3] == (pytest.approx(1 / 3), 1.0)
    assert at[0.95, 0.8] == (0.0, 0.0) and at[0.95, 0.3] == (pytest.approx(1 / 3), 1.0)


def brute_ap(precision, recall):
    mrec = np.concatenate([[0.0], recall, [1.0]])
    mpre = np.concatenate([[1.0], precision, [0.0]])
    mpre = np.flip(np.maximum.accumulate(np.flip(mpre)))
    x = np.linspace(0, 1, 101)
    return np.trapezoid(np.interp(x, mrec, mpre), x)


def random_boxes(n, seed, copies):
    rng = np.random.default_rng(seed)
    wh = np.exp(rng.uniform(1, 5, (n, 2)))
    xy = rng.uniform(0, 200, (n, 2))
    boxes = np.hstack([xy, xy + wh])
    boxes[:copies] = boxes[0]
    return boxes


@pytest.mark.parametrize("limit", [1, 10**9])
def test_matching_against_brute_force(spark, monkeypatch, limit):
    """The same with one cell per image and, for a low limit, with cells by place and size."""
    monkeypatch.setattr(DE, "LARGE_IMAGE_PAIRS", limit)
    truth, base = random_boxes(80, 1, 10), random_boxes(80, 1, 10)
    rng = np.random.default_rng(9)
    preds = np.vstack([base + rng.uniform(-3, 3, base.shape), random_boxes(60, 4, 20)])
    preds[:, 2:] = np.maximum(preds[:, 2:], preds[:, :2] + 0.5)
    conf = np.round(rng.uniform(0, 1, len(preds)), 2)
    p = boxes_frame(spark, [(f"p{i:03d}", 1, *map(float, b), float(conf[i])) for i, b in enumerate(preds)], "pred_key")
    g = boxes_frame(spark, [(f"g{i:03d}", 1, *map(float, b)) for i, b in enumerate(truth)], "gt_key")

    def iou(a, b):
        w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
        h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
        return w * h / (area - w * h)

    want = {}
    for i, a in enumerate(preds):
        over = [(-iou(a, b), f"g{j:03d}") for j, b in enumerate(truth)]
        if -min(over)[0] >= 0.5:
            want[f"p{i:03d}"] = min(over)[1]
    got = {r.pred_key: r.gt_key for r in DE.match_boxes(p, g).collect()}
    assert got == want

    curve = DE.precision_recall_curve(p, g)
    ap = {r.level: r.ap for r in DE.average_precision_per_level(curve).collect()}
    for level in DE.IOU_LEVELS:
        points = sorted(((r.confidence, r.precision, r.recall) for r in curve.collect() if r.level == level), reverse=True)
        assert ap.get(level, 0.0) == pytest.approx(brute_ap([q[1] for q in points], [q[2] for q in points]), abs=1e-9)


@pytest.mark.parametrize("edge_rows", [1, 65_536])
@pytest.mark.parametrize("n", [1, 7, 100, 299, 300, 1000])
def test_sample_equals_sorted_head(spark, monkeypatch, n, edge_rows):
    monkeypatch.setattr(S, "EDGE_ROWS", edge_rows)
    df = spark.range(300).withColumnRenamed("id", "image_id")
    want = {r.image_id for r in df.orderBy(S.random_key(42, "image_id"), "image_id").limit(n).collect()}
    assert {r.image_id for r in S.sample_n(df, n, "image_id").collect()} == want


def test_first_per_identity_in_parts(spark, monkeypatch):
    df = spark.range(400).selectExpr("id AS image_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 5) END AS identity")
    small = [sorted(r.image_id for r in fn(df, 20, "image_id").collect())
             for fn in (S.limit_per_identity, S.sample_per_identity)]
    monkeypatch.setattr(S, "GROUP_LIMIT", 0)
    assert small == [sorted(r.image_id for r in fn(df, 20, "image_id").collect())
                     for fn in (S.limit_per_identity, S.sample_per_identity)]
