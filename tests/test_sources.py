"""Readers and writers on small files, models on small images, the stream."""

import json
import os
import struct
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pyarrow_fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pelage.operators import boxes as B
from pelage.operators import dataset as D
from pelage import session
from pelage.functions.text import folder_name
from pelage.operators import file_benchmark as FB
from pelage.operators import inference as I
from pelage.operators import retrieval as R
from pelage.operators import tiles
from pelage.plans import catalog, io_queries
from pelage.sources import files, label_files, readers, sinks
from pelage.streaming import identify
from pelage.streaming.identify import identify_stream

c = F.col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOC = """<annotation><filename>{name}</filename><size><width>{w}</width><height>{h}</height></size>
<object><name>{obj}</name><bndbox><xmin>25</xmin><ymin>10</ymin><xmax>276</xmax><ymax>498</ymax></bndbox></object></annotation>"""


def test_voc_folder(spark, tmp_path):
    folder = tmp_path / "annotation" / "n01-breed"
    folder.mkdir(parents=True)
    (folder / "img_1").write_text(VOC.format(name="img_1", w=333, h=500, obj="dog"))
    (folder / "img_2").write_text(VOC.format(name="%s", w=333, h=500, obj="dog"))
    (folder / "img_3").write_text("<annotation><filename>img_3</filename><size>")
    boxes = B.voc_box_clean(readers.read_voc_boxes(spark, str(tmp_path / "annotation")))
    rows = boxes.collect()
    assert [(r.file_name, r.x, r.y, r.w, r.h) for r in rows] == [("stanford_dogs/images/n01-breed/img_1.jpg", 25, 10, 251, 488)]


def test_voc_negatives(spark, tmp_path):
    (tmp_path / "a.xml").write_text(VOC.format(name="a.jpg", w=10, h=20, obj="cat"))
    (tmp_path / "b.xml").write_text(VOC.format(name="b.jpg", w=10, h=20, obj="dog"))
    (tmp_path / "c.xml").write_text("<annotation><filename>c.jpg</filename><size><width>1</width><height>1</height></size></annotation>")
    rows = readers.read_voc_negatives(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("oxford_pets/images/a.jpg", 10, 20)]


COCO = {
    "images": [{"id": 1, "file_name": "1.jpg", "width": 200, "height": 200}, {"id": 2, "file_name": "2.jpg", "width": 200, "height": 200}],
    "categories": [{"id": 18, "name": "dog"}, {"id": 1, "name": "person"}],
    "annotations": [{"id": 1, "image_id": 1, "category_id": 18, "bbox": [100, 100, 50, 50], "iscrowd": 0},
                    {"id": 2, "image_id": 2, "category_id": 1, "bbox": [0, 0, 5, 5]}],
}


def test_coco_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(COCO, indent=1))
    doc = readers.read_coco(spark, str(tmp_path / "d.json"))
    boxes = doc["annotations"].withColumnRenamed("id", "ann_key")
    images = doc["images"].withColumnRenamed("id", "image_id")
    dogs = D.target_boxes(boxes, doc["categories"])
    assert [(r.image_id, r.x, r.w, r.iscrowd) for r in dogs.collect()] == [(1, 100.0, 50.0, 0)]
    assert [r.image_id for r in D.negatives_anti(images, dogs).collect()] == [2]


def test_coco_without_lists_is_empty(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"images": COCO["images"]}))
    doc = readers.read_coco(spark, str(tmp_path / "d.json"))
    assert (doc["images"].count(), doc["annotations"].count(), doc["categories"].count()) == (2, 0, 0)


def test_coco_documents_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 10)
    images = spark.range(95).select(
        F.lit("train").alias("split"), "id", F.concat("id", F.lit(".jpg")).alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    boxes = spark.range(40).select(
        "id", (F.col("id") % 7).alias("image_id"), F.lit(1).alias("category_id"), *[F.lit(1.0).alias(k) for k in ("x", "y", "w", "h", "area")], F.lit(0).alias("iscrowd"))
    assert sinks.coco_documents(images, boxes, [{"id": 1, "name": "dog"}]).count() == 10
    sinks.write_coco(images, boxes, [{"id": 1, "name": "dog"}], str(tmp_path / "out"))
    doc = readers.read_coco(spark, str(tmp_path / "out"), multi_line=False)
    assert (doc["images"].count(), doc["annotations"].count()) == (95, 40)


def test_identity_folders(spark, tmp_path):
    for name in ("id_C/a.jpg", "id_C/b.JPEG", "id_D/c.png", "id_D/notes.txt", "id_E/readme", "id D/x/100% of it.jpg", "_tmp/x.jpg", "id_C/.hidden.jpg"):
        path = tmp_path / "root" / "extra" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    (tmp_path / "root" / "extra" / "empty").mkdir()
    folder = str(tmp_path / "root" / "extra")
    found = readers.scan_identity_folders(spark, folder)
    assert sorted(r.identity for r in found.collect()) == ["id_C", "id_C", "id_D", "x"]
    relative = readers.scan_priority_identities(spark, folder, str(tmp_path / "root"))
    assert sorted(r.path for r in relative.collect()) == ["extra/id D/x/100% of it.jpg", "extra/id_C/a.jpg", "extra/id_C/b.JPEG", "extra/id_D/c.png"]
    assert readers.scan_priority_identities(spark, folder + "-missing", "/").count() == 0
    assert readers.scan_identity_folders(spark, folder + "-missing").count() == 0


def test_walk_lists_every_level_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS_PER_TASK", 2)
    for i in range(40):
        path = tmp_path / f"a{i % 5}" / f"b{i % 7}" / f"{i}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * i)
    rows = files.walk(spark, f"file://{tmp_path}").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in rows) == sorted((f"{i}.bin", i) for i in range(40))
    assert all(r.path.startswith(f"file://{tmp_path}/") for r in rows)


def test_paths_get_the_scheme_of_the_default_file_system(spark):
    assert files.qualified(spark, "/data/x") == "file:///data/x"
    assert files.qualified(spark, "hdfs://host/x") == "hdfs://host/x" and files.qualified(spark, "file:/x") == "file:/x"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://names:9000")
        assert files.qualified(spark, "/data/x") == "hdfs://names:9000/data/x"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError):
        files.shared_files("/data/x")


class _Session:
    """What ``scratch_root`` asks a session."""

    def __init__(self, app="app-1", **settings):
        self.settings = settings
        self.sparkContext = type("Context", (), {"applicationId": app})

    @property
    def conf(self):
        return type("Conf", (), {"get": staticmethod(lambda key, default=None: self.settings.get(key.replace(".", "_"), default))})


def test_scratch_folder_without_a_setting():
    one = session.scratch_root(_Session(spark_master="local[3]"))
    assert one.startswith("file:///") and one == session.scratch_root(_Session(spark_master="local[3]"))
    assert one != session.scratch_root(_Session(app="app-2", spark_master="local"))
    assert session.scratch_root(_Session(spark_master="spark://h:7077", spark_checkpoint_dir="hdfs://h/tmp/")) == "hdfs://h/tmp"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            session.scratch_root(_Session(spark_master=master))


def test_scratch_scope_removes_its_folders(spark):
    with session.scratch_scope(spark):
        written = session.materialize(spark.range(5), "scoped")
        assert written.count() == 5
        (path,) = {x.rsplit("/", 1)[0] for x in written.inputFiles()}
        assert os.path.isdir(path.removeprefix("file://").removeprefix("file:"))
    assert not os.path.isdir(path.removeprefix("file://").removeprefix("file:"))


def test_identity_list(spark, tmp_path):
    items = [{"file_path": "img1", "identity_label": "id_A"}, {"file_path": "img2", "identity_label": "id_A"},
             {"file_path": "img3", "identity_label": "id_B"}, {"file_path": "img4"}]
    (tmp_path / "v.json").write_text(json.dumps(items))
    rows = D.filter_unlabelled(readers.read_identity_list(spark, str(tmp_path / "v.json"))).collect()
    assert [(r.image_path, r.identity_label) for r in rows] == [("img1", "id_A"), ("img2", "id_A"), ("img3", "id_B")]


def label_images(spark):
    images = spark.createDataFrame([(1, "s/images/a.jpg", 100, 100), (2, "s/images/b.jpg", 100, 100)], "image_id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([("k1", 1, 40.0, 40.0, 20.0, 20.0), ("k2", 1, -5.0, 0.0, 10.0, 10.0)], "ann_key string, image_id long, x double, y double, w double, h double")
    return images, boxes


def test_label_files_round_trip(spark, tmp_path):
    images, boxes = label_images(spark)
    sinks.write_yolo_detection(images, boxes, str(tmp_path))
    assert (tmp_path / "s/labels/b.txt").read_text() == ""
    assert (tmp_path / "s/labels/a.txt").read_text() == "0 0.500000 0.500000 0.200000 0.200000\n0 0.025000 0.050000 0.050000 0.100000\n"
    labels = readers.read_yolo_labels(spark, str(tmp_path))
    sized = labels.withColumns({"width": F.lit(100), "height": F.lit(100)})
    assert {(r.x1, r.y1, r.x2, r.y2) for r in B.yolo_to_pixels(sized).collect()} == {(40, 40, 60, 60), (0, 0, 5, 10)}
    again = label_files.read_label_files(spark, str(tmp_path)).collect()
    assert sorted((r.label_path, r.position, r.box) for r in again if r.box) == [
        ("s/labels/a.txt", 0, [0.0, 0.5, 0.5, 0.2, 0.2]), ("s/labels/a.txt", 1, [0.0, 0.025, 0.05, 0.05, 0.1])]
    assert [r.label_path for r in again if r.box is None] == ["s/labels/b.txt"]
    assert not (tmp_path / "_drafts").exists()


def test_label_files_are_replaced_or_added(spark, tmp_path):
    images, boxes = label_images(spark)
    sinks.write_yolo_detection(images, boxes, str(tmp_path))
    lines = sinks.yolo_detection_lines(images.withColumn("file_name", F.concat(F.lit("new/"), "file_name")), boxes)
    label_files.write_label_files(lines, str(tmp_path), order="ann_key", mode="append")
    assert label_files.read_label_files(spark, str(tmp_path)).select("label_path").distinct().count() == 4
    label_files.write_label_files(lines, str(tmp_path), order="ann_key")
    assert label_files.read_label_files(spark, str(tmp_path)).select("label_path").distinct().count() == 2
    assert not (tmp_path / "s").exists() and (tmp_path / "new/s/labels/a.txt").exists()
    assert label_files.read_label_files(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failed_write_leaves_no_label_file(spark, tmp_path):
    """A task that dies after others have written: no file in its place, no list, no draft."""
    images, boxes = label_images(spark)
    lines = sinks.yolo_detection_lines(images, boxes)
    bad = lines.unionByName(spark.createDataFrame([("s/labels/c.txt", "k", [float("nan")] * 5, None)], "label_path string, ann_key string, box array<double>, points array<double>"))
    with pytest.raises(Exception):
        label_files.write_label_files(bad, str(tmp_path), order="ann_key")
    assert not list(tmp_path.rglob("*.txt")) and not list(tmp_path.rglob("_list"))


def test_label_files_to_be_read_stand_on_disk_some_at_a_time(spark, tmp_path, monkeypatch):
    """Each portion is written and read once; the rows are those of all files at once, and the files are gone."""
    orders = spark.range(300).select(c("id").alias("o_orderkey"), (c("id") % 7).alias("o_custkey"))
    lineitem = spark.range(900).select(
        (c("id") % 290).alias("l_orderkey"), (c("id") * 37 % 500).alias("l_partkey"), (c("id") * 11 % 70).alias("l_suppkey"),
        c("id").cast("int").alias("l_linenumber"), (c("id") % 50).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit("A").alias("l_returnflag"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    query, standing = catalog.queries()["read_yolo_labels"], []
    want = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    roots, plain = [], sinks.write_yolo_detection

    def write(images, boxes, root):
        plain(images, boxes, root)
        roots.append(root.removeprefix("file://"))
        standing.append(sum(x.endswith(".txt") for r in roots for _, _, names in os.walk(r) for x in names))

    monkeypatch.setattr(io_queries, "LABEL_FILES_AT_ONCE", 75)
    monkeypatch.setattr(sinks, "write_yolo_detection", write)
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 500
    assert len(standing) == 4 and sum(standing) == 300 and max(standing) < 150
    assert not any(os.path.exists(r) for r in roots)


def test_a_folder_of_one_task_is_moved_as_a_whole(tmp_path, monkeypatch):
    """Files of a folder that two tasks have written, that has a folder below it or stands already are moved one by one."""
    moved = []

    class Counting(pyarrow_fs.LocalFileSystem):
        def move(self, source, target):
            moved.append(target.removeprefix(f"{tmp_path}/"))
            super().move(source, target)

    monkeypatch.setattr(label_files, "shared_files", lambda root: (Counting(), root.removeprefix("file://")))
    (tmp_path / "old").mkdir()
    writer, messages = label_files._Writer(f"file://{tmp_path}", 0, False), []
    for number, names in enumerate((["own/a.txt", "own/b.txt", "own/c.txt", "two/a.txt", "up/a.txt", "old/a.txt"], ["two/b.txt", "up/low/a.txt", "flat.txt"], [])):
        monkeypatch.setattr(label_files, "TaskContext", SimpleNamespace(get=lambda n=number: SimpleNamespace(partitionId=lambda: n, taskAttemptId=lambda: 0)))
        rows = pa.table({"label_path": pa.array(names, pa.string()), "position": pa.array([2] * len(names), pa.int64()),
                         "box": pa.array([[0.0, 0.5, 0.5, 0.25, 0.25]] * len(names), pa.list_(pa.float64())),
                         "points": pa.array([[]] * len(names), pa.list_(pa.float64()))})
        messages.append(writer.write(iter(rows.to_batches())))
    writer.commit(messages)
    found = sorted(str(x.relative_to(tmp_path)) for x in tmp_path.rglob("*.txt"))
    assert found == ["flat.txt", "old/a.txt", "own/a.txt", "own/b.txt", "own/c.txt", "two/a.txt", "two/b.txt", "up/a.txt", "up/low/a.txt"]
    assert sorted(x for x in moved if not x.startswith("_labels")) == ["flat.txt", "old/a.txt", "own", "two/a.txt", "two/b.txt", "up/a.txt", "up/low"]
    assert (tmp_path / "own/a.txt").read_text() == "0 0.500000 0.500000 0.250000 0.250000\n" and not (tmp_path / "_drafts").exists()


def test_lists_to_be_written_have_no_nulls(spark, tmp_path, monkeypatch):
    """A missing box or missing keypoints still differ from empty ones."""
    seen = []
    monkeypatch.setattr(label_files, "_lists", lambda column, plain=label_files._lists: seen.append(column.null_count) or plain(column))
    batch = pa.RecordBatch.from_pydict({"x": pa.array([[1.0, 2.0], [], [None]], pa.list_(pa.float64()))})
    assert label_files._lists(batch.column("x").slice(1)) == [[], [None]] and label_files._lists(batch.column("x").slice(0, 2)) == [[1.0, 2.0], []]
    lines = spark.createDataFrame(
        [("a/1.txt", 0, [0.0, 0.5, 0.5, 0.5, 0.5], None), ("a/1.txt", 1, [0.0, 0.5, 0.5, 0.5, 0.5], [0.25, 0.5, 2.0]), ("a/2.txt", 0, None, None)],
        "label_path string, position long, box array<double>, points array<double>")
    label_files.write_label_files(lines, str(tmp_path), joints=1, paths=lines.select("label_path").distinct())
    assert (tmp_path / "a/1.txt").read_text() == "0 0.500000 0.500000 0.500000 0.500000 0 0 0\n0 0.500000 0.500000 0.500000 0.500000 0.250000 0.500000 2\n"
    assert (tmp_path / "a/2.txt").read_text() == ""


def test_folders_to_be_listed_stand_on_disk_some_at_a_time(spark, tmp_path, monkeypatch):
    """Each folder is written and listed once, in one portion; the rows are those of all at once, and the files are gone."""
    spark.range(300).select(c("id").alias("o_orderkey"), (c("id") % 40).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    query, standing, roots, plain = catalog.queries()["scan_identity_folders"], [], [], io_queries._folder_files
    want = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())

    def write(t, images, name):
        roots.append(plain(t, images, name).removeprefix("file://"))
        standing.append(sorted(f"{os.path.basename(at)}/{x}" for r in roots for at, _, names in os.walk(r) for x in names if not x.startswith(".")))
        return roots[-1]

    monkeypatch.setattr(io_queries, "LISTED_FILES_AT_ONCE", 75)
    monkeypatch.setattr(io_queries, "_folder_files", write)
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 200
    assert len(standing) == 4 and max(map(len, standing)) < 200
    every = [x for names in standing for x in names]
    assert len(every) == len(set(every)) == 300
    folders = [{x.split("/")[0] for x in names} for names in standing]
    assert sum(map(len, folders)) == len(set().union(*folders)) == 40
    assert not any(os.path.exists(r) for r in roots)


def test_name_of_the_folder_of_a_file(spark):
    paths = ["a/b/c.jpg", "b/c.jpg", "/c.jpg", "c.jpg", "a//c.jpg", "a/b/", "", "file:///a/b b/c.jpg", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
        folder_name(c("path")).alias("got"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] == ["b", "b", "", "", "", "", "", "b b", None]


def test_an_image_with_very_many_boxes_is_one_file_in_order(spark, tmp_path):
    lines = spark.range(30_000).select(
        F.lit("a/big.txt").alias("label_path"), c("id").alias("position"), F.array(F.lit(0), c("id") / 1e5, F.lit(0.5), F.lit(0.1), F.lit(0.1)).alias("box"),
        F.when(c("id") % 2 == 0, F.array(F.lit(0.25), F.lit(0.5), F.lit(2.0))).alias("points")).repartition(6)
    label_files.write_label_files(lines, str(tmp_path), joints=1)
    text = (tmp_path / "a/big.txt").read_text().splitlines()
    assert len(text) == 30_000 and text[2] == "0 0.000020 0.500000 0.100000 0.100000 0.250000 0.500000 2"
    assert text[29_999] == "0 0.299990 0.500000 0.100000 0.100000 0 0 0"
    back = label_files.read_label_files(spark, str(tmp_path))
    assert back.filter("size(points) = 3").count() == 30_000 and back.agg(F.max("position")).first()[0] == 29_999


def test_pose_label_lines_parse(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0 0.5 0.5 0.2 0.2" + " 0.5 0.5 2" * 17 + "\n0 0.1\n")
    rows = readers.read_yolo_labels(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and len(rows[0].keypoints) == 17 and rows[0].keypoints[0].v == 2.0


def test_dataset_config(spark, tmp_path):
    categories = spark.createDataFrame([(1, "dog")], "id long, name string")
    sinks.write_dataset_config(sinks.dataset_config(categories, "data", "t", "v", keypoints=True), str(tmp_path / "c"))
    row = spark.read.json(str(tmp_path / "c")).first()
    assert (row.nc, row.names, row.kpt_shape, row.flip_idx) == (1, ["dog"], [4, 3], [0, 1, 3, 2])


def test_training_log_and_metrics_append(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"epoch": 1, "phase": "warmup", "train_loss": 1.5, "val_metrics": {"mAP": 0.25}, "epoch_time": 2.0}, {"epoch": 2, "phase": "warmup", "val_metrics": {}}]))
    rows = readers.read_training_history(spark, str(tmp_path / "m.json")).orderBy("epoch").collect()
    assert [r.map_score for r in rows] == [0.25, None]
    log = spark.createDataFrame([("r", "mrr", 0.5)], "run string, metric string, value double")
    for _ in range(2):
        sinks.append_metrics(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def png(path, pixels):
    h, w, ch = pixels.shape
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if ch == 3 else 0, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_images_decode_and_broken_ones_go_or_stay(spark, tmp_path):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    png(tmp_path / "a.png", pixels)
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    rows = readers.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (I.rgb_array(r.height, r.width, r.nChannels, bytes(r.data)) == pixels).all()
    assert I.to_model_input(pixels).shape == (3, 2, 3)
    both = {r.path.rsplit("/", 1)[1]: r for r in readers.read_images(spark, str(tmp_path), keep_failed=True).collect()}
    assert both["a.png"].height == 2 and both["b.jpg"].height is None and both["b.jpg"].data is None


def counting(log, name, answer):
    """A model that notes each image it is given."""
    def load():
        def predict(batch):
            with open(log, "a") as out:
                out.write(f"{name}\n" * len(batch))
            return [answer(x) for x in batch]

        return predict

    return load


def test_folder_to_report(spark, tmp_path):
    """Broken and missing files count as no animal, every image is scored once, a second run reads the gallery."""
    folder, log, output = tmp_path / "my data", tmp_path / "log", str(tmp_path / "out")
    rng = np.random.default_rng(3)
    (folder / "x").mkdir(parents=True)
    for i in range(12):
        png(folder / "x" / f"{i}.png", rng.integers(1, 255, (6, 6, 1), dtype=np.uint8))
    (folder / "x" / "broken.png").write_bytes(b"\x89PNG\r\n")
    png(folder / "x" / "empty.png", np.zeros((6, 6, 1), np.uint8))
    names = [f"x/{i}.png" for i in range(12)] + ["x/broken.png", "x/empty.png", "x/missing.png"]
    truth = spark.createDataFrame([(n, None if i % 6 == 5 else i % 3) for i, n in enumerate(names)], "image_path string, identity_label int")
    detector = counting(log, "detect", lambda x: [[0.0, 0.0, 640.0, 640.0, 0.9 if x.max() else 0.1, 0.0]])
    embedder = counting(log, "embed", lambda x: x.reshape(-1).astype(np.float32))
    report = {(r.metric, r.k): r.value for r in FB.run_benchmark(spark, truth, str(folder), output, detector, embedder, k=3).collect()}
    assert log.read_text().split().count("detect") == 13 and log.read_text().split().count("embed") == 12
    labelled = sum(i % 6 != 5 for i in range(15))
    assert report["total_images", None] == 15 and report["animal_images", None] == labelled
    found = sum(i % 6 != 5 for i in range(12))
    assert report["detection_recall", None] == pytest.approx(found / labelled)
    gallery = FB.open_gallery(spark, f"{output}/gallery")
    assert (gallery.images, gallery.embedded, gallery.unreadable, gallery.dimensions) == (14, 12, 1, 36)
    assert {r.status for r in gallery.items.collect()} == {"embedded", "no_animal", "unreadable"}
    saved = spark.read.json(f"{output}/results").collect()
    assert len(saved) == 15 and {len(r.similar_images) for r in saved if r.has_animal_pred} == {3}
    assert all(r.similar_images == [] for r in saved if not r.has_animal_pred)
    again = FB.run_benchmark(spark, truth, str(folder), output, detector, embedder, k=3)
    assert {(r.metric, r.k): r.value for r in again.collect()} == report
    assert log.read_text().split().count("detect") == 13
    assert spark.read.parquet(f"{output}/metrics").select("run").distinct().count() == 1
    assert FB.open_gallery(spark, str(tmp_path / "none")) is None


# ---- models -----------------------------------------------------------------

def image_frame(spark, n=3, side=100):
    data = bytearray(np.full(side * side, 7, np.uint8).tobytes())
    return spark.createDataFrame([(i, side, side, 1, data) for i in range(n)], "image_id long, height int, width int, nChannels int, data binary")


def detector(rows):
    return lambda: lambda batch: [rows for _ in batch]


def embedder():
    return lambda batch: [[float(crop.shape[1]), float(crop.shape[0])] for crop in batch]


@pytest.mark.parametrize("rows, size", [
    ([[10.0, 10.0, 90.0, 90.0, 0.9, 0.0]], [96.0, 96.0]),
    ([[10.0, 10.0, 90.0, 90.0, 0.4, 0.0]], None),
    ([], None),
    ([[10.0, 10.0, 20.0, 90.0, 0.9, 0.0], [0.0, 0.0, 50.0, 50.0, 0.95, 0.0]], [55.0, 55.0]),
])
def test_scoring_flow(spark, rows, size):
    scored = I.score_images(image_frame(spark), detector(rows), embedder_loader, detector_size=(100, 100))
    assert [r.embedding for r in scored.collect()] == [size] * 3
    assert I.build_gallery(scored).count() == (0 if size is None else 3)


def embedder_loader():
    return embedder()


def test_keypoints_shrink_the_crop(spark):
    def keypoints():
        return lambda batch: [[[0.0] * 4 + [0.9, 0.0] + [40.0, 40.0, 1.0, 60.0, 60.0, 1.0] * 2] for _ in batch]

    scored = I.score_images(
        image_frame(spark), detector([[10.0, 10.0, 90.0, 90.0, 0.9, 0.0]]), embedder_loader, keypoints,
        detector_size=(100, 100), keypoint_size=(96, 96))
    assert scored.first().embedding == [28.0, 28.0]


def test_other_class_has_no_embedding(spark):
    found = I.detect_batch(image_frame(spark), detector([[10.0, 10.0, 90.0, 90.0, 0.9, 0.0]]), (100, 100), animal_class="cat")
    assert found.select(I.confident_targets(F.col("detections"))).first()[0] == []
    classes = I.classify_images(image_frame(spark), detector([[1.0, 1.0, 9.0, 9.0, 0.3, 0.0]]), input_size=(100, 100))
    assert {r.animal_class for r in classes.collect()} == {"no_animal"}


def test_stream_matches_batch_and_survives_restart(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    gallery = spark.createDataFrame(rows, "id long, embedding array<float>")
    source = str(tmp_path / "in")
    gallery.limit(10).write.parquet(source)

    def run():
        probes = spark.readStream.schema(gallery.schema).parquet(source)
        identify_stream(probes, gallery, str(tmp_path / "out"), str(tmp_path / "state"), 3).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 30
    assert run() == 30
    gallery.filter("id >= 25").write.mode("append").parquet(source)
    assert run() == 45
    assert os.path.isdir(tmp_path / "out" / "batch=1")


def test_stream_batches_leave_the_gallery_in_its_buckets(spark, tmp_path, monkeypatch):
    """The gallery is placed once; a batch's plan has no exchange above its scan."""
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 64)
    monkeypatch.setattr(tiles, "MIN_BLOCK_ROWS", 32)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    gallery = spark.createDataFrame([*rows, (999, None)], "id long, embedding array<float>")
    placed = identify.place_gallery(gallery)
    try:
        assert placed.blocks > 4 and placed.rows == 400
        ranked = identify.rank_batch(gallery.filter("id < 30"), placed, 3)
        plan = ranked._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(plan) if placed.table in line)
        assert "Bucketed: true" in plan[scan]
        depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-"))
        above = []
        for line in reversed(plan[:scan]):
            indent = len(line) - len(line.lstrip(" :+-"))
            if indent < depth:
                above.append(line)
                depth = indent
            if "FlatMapCoGroupsInArrow" in line:
                break
        assert above and not any("Exchange" in line for line in above)
        want = {tuple(r) for r in R.topk_neighbors(gallery.filter("id < 30"), 3, gallery.filter("embedding is not null")).collect()}
        assert {tuple(r) for r in ranked.collect()} == want
    finally:
        placed.drop()


def test_stream_with_a_trigger_of_its_own(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0]) for i in range(20)]
    gallery = spark.createDataFrame(rows, "id long, embedding array<float>")
    gallery.repartition(4).write.parquet(str(tmp_path / "in"))
    probes = spark.readStream.schema(gallery.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = identify_stream(probes, identify.place_gallery(gallery), str(tmp_path / "out"), str(tmp_path / "state"), 2, {"processingTime": "0 seconds"})
    stream.processAllAvailable()
    stream.stop()
    assert len([x for x in os.listdir(tmp_path / "out") if x.startswith("batch=")]) > 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
