"""File sources and sinks: tables derived from the given ones are written to the
shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pelage.functions import geometry as G
from pelage.operators import boxes as B
from pelage.operators import dataset as D
from pelage.operators import evaluation as E
from pelage.operators import retrieval as R
from pelage.operators import splits as S
from pelage.operators.file_benchmark import run_benchmark
from pelage.plans.bindings import with_views
from pelage.plans.dataset_queries import CATEGORIES, IDENTITY_SPLIT, SPLIT_IMAGES, categories_of
from pelage.plans.embedding_queries import EVALUATED, REPORT, TARS
from pelage.plans.geometry_queries import _clean as CLEAN_BOXES
from pelage.plans.geometry_queries import _CLAMPED, _joints, _validated
from pelage.plans.geometry_queries import POSE_POINTS as _POSE_SQL
from pelage.plans.model_queries import _EMBEDDING, SCORED, SIDE, load_detector, load_embedder, load_keypoints, pixel_hex
from pelage.plans.registry import query
from pelage.session import scratch_dir, scratch_scope, shuffles_removed
from pelage.sources import readers, sinks
from pelage.sources.files import write_files
from pelage.sources.label_files import read_label_files

c = F.col

# ---- COCO -------------------------------------------------------------------

DOG = [{"id": 1, "name": "dog", "supercategory": "animal"}]


def _coco_round_trip(t):
    images = S.image_split(t.images).select("split", c("image_id").alias("id"), "file_name", "width", "height")
    boxes = B.coco_box_clean(t.sized.filter(c("category_id") == 18))
    split = boxes.join(images.select(c("id").alias("image_id"), "split"), "image_id")
    numbered = S.sequential_ids(split, "ann_key", name="id").select(
        "id", "image_id", F.lit(1).alias("category_id"), "x", "y", "w", "h", "area", "iscrowd")
    path = scratch_dir(t.spark, "coco")
    sinks.write_coco(images, numbered, DOG, path)
    return readers.read_coco(t.spark, path, multi_line=False)


@query("read_coco", with_views("SELECT image_id AS id, file_name, width, height FROM fx_images"))
def read_coco(t):
    return _coco_round_trip(t)["images"].drop("source_dataset")


_DOG_BOXES = CLEAN_BOXES.replace("FROM fx_sized", "FROM fx_sized WHERE category_id = 18")


@query("write_coco", with_views(f"""
SELECT row_number() OVER (ORDER BY split, md5(concat_ws('|', '0', ann_key)), ann_key) - 1 AS id, b.image_id,
  CAST(1 AS BIGINT) AS category_id, x, y, w, h, area, 0 AS iscrowd
FROM ({_DOG_BOXES}) b JOIN split_images i ON b.image_id = i.image_id""", SPLIT_IMAGES))
def write_coco(t):
    return _coco_round_trip(t)["annotations"].drop("keypoints", "num_keypoints")


# ---- VOC: one document per box, the class folder is the source ----------------

def _write_voc(t, file_name):
    documents = t.sized.select(
        "source", file_name.alias("filename"),
        F.struct("width", "height").alias("size"),
        F.array(F.struct(
            c("class").alias("name"),
            F.struct(c("x").alias("xmin"), c("y").alias("ymin"), (c("x") + c("w")).alias("xmax"),
                     (c("y") + c("h")).alias("ymax")).alias("bndbox"))).alias("object"))
    path = scratch_dir(t.spark, "voc")
    documents.write.partitionBy("source").format("xml").option("rowTag", "annotation").option(
        "rootTag", "annotations").option("compression", "gzip").save(path)
    return path


@query("read_voc_boxes", with_views("""
SELECT concat('stanford_dogs/images/source=', source, '/', ann_key, '.jpg') AS file_name, width, height,
  x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax FROM fx_sized"""))
def read_voc_boxes(t):
    return readers.read_voc_boxes(t.spark, _write_voc(t, c("ann_key")))


@query("read_voc_negatives", with_views("""
SELECT concat('oxford_pets/images/', ann_key, '.jpg') AS file_name, width, height FROM fx_sized WHERE class <> 'dog'"""))
def read_voc_negatives(t):
    return readers.read_voc_negatives(t.spark, _write_voc(t, F.concat("ann_key", F.lit(".jpg"))))


# ---- JSON lists -------------------------------------------------------------

@query("read_keypoint_entries", """
SELECT concat('dogs/', vec_id, '.jpg') AS img_path, CAST(vec_id % 50 AS DOUBLE) AS x, CAST(vec_id % 40 AS DOUBLE) AS y,
  CAST(100 + vec_id % 300 AS DOUBLE) AS w, CAST(90 + vec_id % 200 AS DOUBLE) AS h, CAST(i AS INT) AS joint,
  CAST(embedding[3 * i + 1] AS DOUBLE) * 400 + 200 AS joint_x, CAST(embedding[3 * i + 2] AS DOUBLE) * 400 + 200 AS joint_y,
  CASE WHEN embedding[3 * i + 3] > 0 THEN 1.0e0 ELSE 0.0e0 END AS joint_v, vec_id % 2 = 0 AS is_multiple_dogs
FROM embeddings, range(0, 21) AS j(i)""")
def read_keypoint_entries(t):
    """All 21 joints of every entry, a row each."""
    box = [c("id") % 50, c("id") % 40, c("id") % 300 + 100, c("id") % 200 + 90]
    entries = _joints(t).select(
        F.concat(F.lit("dogs/"), "id", F.lit(".jpg")).alias("img_path"), F.array(*box).alias("img_bbox"), "joints",
        (c("id") % 2 == 0).alias("is_multiple_dogs"))
    path = scratch_dir(t.spark, "keypoint-entries")
    entries.write.json(path)
    back = readers.read_keypoint_entries(t.spark, path, multi_line=False)
    return back.select("img_path", "x", "y", "w", "h", "is_multiple_dogs", F.posexplode("joints").alias("joint", "at")).select(
        "img_path", "x", "y", "w", "h", "joint", *[c("at")[i].alias(f"joint_{k}") for i, k in enumerate("xyv")], "is_multiple_dogs")


@query("read_identity_list", with_views("SELECT file_path AS image_path, identity AS identity_label FROM fx_identities"))
def read_identity_list(t):
    path = scratch_dir(t.spark, "identity-list")
    t.identities.select("file_path", c("identity").alias("identity_label")).write.json(path)
    return readers.read_identity_list(t.spark, path, multi_line=False)


@query("write_identity_splits", with_views("""
SELECT split, file_path, row_number_label AS identity_label, 'unknown' AS breed_label FROM (
  SELECT s.split, i.file_path, dense_rank() OVER (ORDER BY i.identity) - 1 AS row_number_label
  FROM fx_identities i JOIN identity_splits s ON i.identity = s.identity) x""", IDENTITY_SPLIT))
def write_identity_splits(t):
    kept = S.filter_min_per_identity(t.identities)
    labels = S.dense_label_ids(kept).withColumnRenamed("label", "identity_label")
    rows = kept.join(S.identity_split(t.identities).select("identity", "split"), "identity").join(labels, "identity")
    path = scratch_dir(t.spark, "identity-splits")
    sinks.write_identity_splits(rows, path)
    schema = "file_path string, identity_label long, breed_label string, split string"
    return t.spark.read.schema(schema).json(path)


@query("write_eval_results", with_views("""
SELECT r.id, gt AS has_animal_gt, pred AS has_animal_pred, r.identity_gt, detection_correct, r.identity_rank, m.rn AS rank,
  m.b AS match_id, m.s AS similarity
FROM results r LEFT JOIN (SELECT * FROM granked WHERE rn <= 5) m ON r.id = m.a""", *EVALUATED))
def write_eval_results(t):
    """Saved results with the five best matches of each probe, a row per match."""
    matches = R.topk_neighbors(E.gallery_of(t.probes).select("id", "embedding"), 5)
    results = E.with_matches(E.evaluate(t.probes), matches, 5)
    path = scratch_dir(t.spark, "eval-results")
    sinks.write_eval_results(results, path)
    saved = t.spark.read.schema(results.schema).json(path)
    kept = [k for k in saved.columns if k != "similar_images"]
    return saved.select(*kept, F.posexplode_outer("similar_images").alias("rank", "m")).select(
        *kept, (c("rank") + 1).cast("long").alias("rank"), c("m.id").alias("match_id"), c("m.similarity").alias("similarity"))


_EPOCHS = """SELECT epoch, phase, map_score / 2 AS train_loss, map_score, map_score * 3 AS epoch_time FROM fx_history"""


def _history_round_trip(t):
    log = t.history.select(
        "epoch", "phase", (c("map_score") / 2).alias("train_loss"),
        F.create_map(F.lit("mAP"), c("map_score")).alias("val_metrics"), (c("map_score") * 3).alias("epoch_time"))
    path = scratch_dir(t.spark, "training-history")
    sinks.write_training_history(log, path)
    return readers.read_training_history(t.spark, path, multi_line=False)


@query("read_training_history", with_views(_EPOCHS))
def read_training_history(t):
    return _history_round_trip(t).drop("val_metrics")


@query("write_training_history", with_views(
    "SELECT phase, count(*) AS n_epochs, max(map_score) AS best FROM fx_history GROUP BY phase"))
def write_training_history(t):
    return _history_round_trip(t).groupBy("phase").agg(F.count("*").alias("n_epochs"), F.max("map_score").alias("best"))


# ---- portions of files --------------------------------------------------------

def _dealt(t, df, portions: int, name: str, key: str = "image_id"):
    """``df`` written once, in a folder per portion of the keys."""
    path = scratch_dir(t.spark, name)
    portion = F.pmod(F.xxhash64(key), F.lit(portions)).cast("int").alias("_portion")
    df.select("*", portion).write.option("compression", "zstd").partitionBy("_portion").parquet(path)
    schema = StructType([*df.schema, StructField("_portion", IntegerType())])
    return t.spark.read.schema(schema).parquet(path)


def _by_portions(t, tables, portions: int, name: str, found_of):
    """What ``found_of`` finds in the files it makes of its portion of each table, written; a portion's files are
    deleted before the next are made."""
    found = scratch_dir(t.spark, name)
    for portion in range(portions):
        with scratch_scope(t.spark):
            rows = found_of(*[x.filter(c("_portion") == portion).drop("_portion") for x in tables])
            rows.write.mode("append").option("compression", "zstd").parquet(found)
    return t.spark.read.schema(rows.schema).parquet(found)


# ---- identity folders -------------------------------------------------------

# Files of one task; files that stand at one time to be listed (an inode each, and a block per folder).
FILES_PER_TASK, LISTED_FILES_AT_ONCE = 10_000, 1_000_000


def _folder_files(t, images, name: str) -> str:
    """A folder with one file per image at its path. A listing reads names alone, so the files are empty: a body
    would take a block of the disk each. A folder's files are one task's, so tasks do not wait for each other in it."""
    root = scratch_dir(t.spark, name)
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-images.count() // FILES_PER_TASK))
    dealt = images.repartition(tasks, F.regexp_extract("name", "^(.*)/", 1)).sortWithinPartitions("name")
    write_files(dealt.select("name", F.lit("").cast("binary").alias("body")), root)
    return root


def _below(root: str):
    return F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)


@query("scan_identity_folders", with_views("""
SELECT concat('id_', o_custkey) AS identity, concat('data/id_', o_custkey, '/', o_orderkey, '.JPG') AS path FROM orders
WHERE o_orderkey % 3 <> 0"""))
def scan_identity_folders(t):
    """Real folders; every third file is not an image.

    A file takes an inode however empty it is, and file systems have a fixed number of them, so the folders to be
    listed stand there some at a time: a portion's are written, listed and deleted before the next.
    """
    suffix = F.when(c("image_id") % 3 == 0, ".txt").otherwise(".JPG")

    def listed(images):
        root = _folder_files(t, images, "folders")
        return readers.scan_identity_folders(t.spark, root).select("identity", _below(root).alias("path"))

    images = t.identities.select(F.concat(F.regexp_replace("file_path", r"\.jpg$", ""), suffix).alias("name"))
    portions = -(-images.count() // LISTED_FILES_AT_ONCE)
    if portions <= 1:
        return listed(images)
    folders = images.withColumn("_folder", F.regexp_extract("name", "^(.*)/", 1))
    with shuffles_removed(t.spark):
        dealt = _dealt(t, folders, portions, "folder-names", "_folder")
        return _by_portions(t, [dealt], portions, "listed", listed)


@query("scan_priority_identities", with_views("""
SELECT regexp_extract(file_path, '([^/]+)/[^/]+$', 1) AS identity, file_path AS path FROM fx_identities WHERE is_priority"""))
def scan_priority_identities(t):
    """Real folders with paths relative to their root, and a folder that does not exist."""
    root = _folder_files(t, t.identities.filter("is_priority").select(c("file_path").alias("name")), "priority")
    found = readers.scan_priority_identities(t.spark, root, root)
    return found.unionByName(readers.scan_priority_identities(t.spark, root + "-missing", root))


# ---- labels -----------------------------------------------------------------

_YOLO = f"""yolo AS (SELECT image_id, ann_key, (x + w / 2) / width AS xc, (y + h / 2) / height AS yc, w / width AS w,
  h / height AS h FROM ({_CLAMPED}) k WHERE w > 0 AND h > 0)"""
_LABEL_PATH = "regexp_replace(replace(file_name, 'images', 'labels'), '\\.jpg$', '.txt')"


# Numbers of label files in millionths, as they are printed.
def _printed(expr: str) -> str:
    return f"CAST(round(CAST(printf('%.6f', {expr}) AS DOUBLE) * 1000000) AS BIGINT)"


def _millionths(value):
    return F.round(value * 1000000).cast("long")


_NUMBERS = ("xc", "yc", "w", "h")


@query("write_yolo_detection", with_views(f"""
SELECT {_LABEL_PATH} AS label_path, count(y.ann_key) AS n_lines, {", ".join(
    f"CAST(coalesce(sum({_printed(f'y.{k}')}), 0) AS BIGINT) AS {k}" for k in _NUMBERS)}
FROM fx_images i LEFT JOIN yolo y ON i.image_id = y.image_id GROUP BY ALL""", _YOLO))
def write_yolo_detection(t):
    """A label file per image, read again by the writer's lists; sums of the printed numbers."""
    path = scratch_dir(t.spark, "yolo-labels")
    sinks.write_yolo_detection(t.images, t.boxes, path)
    lines = read_label_files(t.spark, path)
    return lines.groupBy("label_path").agg(F.count("box").alias("n_lines"), *[
        F.coalesce(F.sum(_millionths(c("box")[i + 1])), F.lit(0)).alias(k) for i, k in enumerate(_NUMBERS)])


# Images whose label files stand on disk at one time.
LABEL_FILES_AT_ONCE = 200_000


@query("read_yolo_labels", with_views(f"""
SELECT {_LABEL_PATH} AS label_path, 0.0e0 AS cls, {", ".join(f"{_printed(f'y.{k}')} AS {k}" for k in _NUMBERS)}
FROM fx_images i JOIN yolo y ON i.image_id = y.image_id""", _YOLO))
def read_yolo_labels(t):
    """Every line of the label files, found by walking their folders.

    A file takes a block of the disk however short it is, so the files to be read stand there some images at a
    time: a portion's are written, read and deleted before the next.
    """
    def lines_of(images, boxes):
        path = scratch_dir(t.spark, "yolo-labels")
        sinks.write_yolo_detection(images, boxes, path)
        lines = readers.read_yolo_labels(t.spark, path).withColumnRenamed("file", "path")
        return lines.select(_below(path).alias("label_path"), "cls", *[_millionths(c(k)).alias(k) for k in _NUMBERS])

    portions = -(-t.images.count() // LABEL_FILES_AT_ONCE)
    if portions <= 1:
        return lines_of(t.images, t.boxes)
    with shuffles_removed(t.spark):
        images = _dealt(t, t.images.select("image_id", "file_name", "width", "height"), portions, "yolo-images")
        boxes = _dealt(t, t.boxes.select("image_id", "ann_key", "x", "y", "w", "h"), portions, "yolo-boxes")
        return _by_portions(t, [images, boxes], portions, "yolo-lines", lines_of)


@query("filter_nonempty_labels", with_views(f"""
SELECT image_id, {_LABEL_PATH} AS label_path FROM fx_images WHERE image_id IN (SELECT image_id FROM yolo)""", _YOLO))
def filter_nonempty_labels(t):
    lines = sinks.yolo_detection_lines(t.images, t.boxes)
    images = t.images.select("image_id", sinks.label_path(c("file_name")).alias("label_path"))
    return D.filter_nonempty_labels(images, lines)


_E = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(61, 65)]
_POSE_BOX = {"xc": f"(({_E[0]} * 50 + 20) + ({_E[2]} * 100 + 140) / 2) / 180", "yc": f"(({_E[1]} * 50 - 7) + ({_E[3]} * 90 + 120) / 2) / 160",
             "w": f"({_E[2]} * 100 + 140) / 180", "h": f"({_E[3]} * 90 + 120) / 160"}
_POSE_POINTS = [f"k{i}_{p}" for i in range(4) for p in "xyv"]


@query("write_yolo_pose", f"""
WITH pose AS (SELECT vec_id AS id, {", ".join(f"{v} AS {k}" for k, v in _POSE_BOX.items())} FROM embeddings),
points AS ({_POSE_SQL})
SELECT concat(pose.id, '.txt') AS label_path, CAST(1 AS BIGINT) AS n_lines, {", ".join(
    f"{_printed(k)} AS {k}" for k in (*_NUMBERS, *_POSE_POINTS))} FROM pose JOIN points ON pose.id = points.id""")
def write_yolo_pose(t):
    """One box with four keypoints per embedding, both made of its components."""
    images = t.items.select(
        c("id").alias("image_id"), F.concat(F.lit("poses/images/"), "id", F.lit(".jpg")).alias("file_name"),
        F.lit(180).alias("width"), F.lit(160).alias("height"))
    e = [c("embedding")[i].cast("double") for i in range(60, 64)]
    corners = t.items.select("id", (e[0] * 50 + 20).alias("x"), (e[1] * 50 - 7).alias("y"), (e[2] * 100 + 140).alias("w"), (e[3] * 90 + 120).alias("h"))
    boxes = _validated(t).join(corners, "id").select(
        c("id").alias("image_id"), F.md5(c("id").cast("string")).alias("ann_key"), "x", "y", "w", "h",
        c("k").alias("keypoints"), G.count_visible(c("k")).alias("num_keypoints"))
    path = scratch_dir(t.spark, "pose-labels")
    sinks.write_yolo_pose(images, boxes, path)
    found = read_label_files(t.spark, path).groupBy("label_path").agg(
        F.count("box").alias("n_lines"), F.first("box").alias("box"), F.first("points").alias("points"))
    return found.select(
        "label_path", "n_lines", *[_millionths(c("box")[i + 1]).alias(k) for i, k in enumerate(_NUMBERS)],
        *[_millionths(c("points")[i]).alias(k) for i, k in enumerate(_POSE_POINTS)])


@query("sorted_paths", with_views("SELECT file_name AS path FROM fx_images"))
def sorted_paths(t):
    return sinks.sorted_paths(t.images)


@query("write_split_lists", with_views("SELECT split, file_name AS path FROM split_images", SPLIT_IMAGES))
def write_split_lists(t):
    path = scratch_dir(t.spark, "split-lists")
    sinks.write_split_lists(S.image_split(t.images), path)
    return t.spark.read.text(path).select("split", c("value").alias("path"))


# ---- images -----------------------------------------------------------------

def _encode_png(batches):
    """Grey ``SIDE`` x ``SIDE`` pixels as PNG files; a broken one loses its second half."""
    import struct
    import zlib

    import pyarrow as pa

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(pixels: bytes) -> bytes:
        lines = b"".join(b"\0" + pixels[i:i + SIDE] for i in range(0, len(pixels), SIDE))
        return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, SIDE, 8, 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))

    for batch in batches:
        bodies = [png(x) for x in batch.column("data").to_pylist()]
        bodies = [x[:len(x) // 2] if bad else x for x, bad in zip(bodies, batch.column("broken").to_pylist())]
        yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "body": pa.array(bodies, pa.binary())})


def _image_files(t, wanted: str, broken: str) -> str:
    """A folder with the embeddings as image files: those that are ``wanted``, some of them ``broken``."""
    root = scratch_dir(t.spark, "images")
    pixels = t.items.filter(wanted).select(
        F.concat(F.lit("id_"), c("id") % 17, F.lit("/"), "id", F.lit(".png")).alias("name"),
        F.unhex(pixel_hex(c("embedding"))).alias("data"), F.expr(broken).alias("broken"))
    write_files(pixels.mapInArrow(_encode_png, "name string, body binary"), root)
    return root


@query("read_images", """
SELECT vec_id AS id, vec_id % 13 = 5 AS failed, CASE WHEN vec_id % 13 <> 5 THEN 8 END AS height,
  CASE WHEN vec_id % 13 <> 5 THEN 8 END AS width, CASE WHEN vec_id % 13 <> 5 THEN 1 END AS channels,
  CASE WHEN vec_id % 13 <> 5 THEN upper(array_to_string(list_transform(embedding,
  lambda x: printf('%02x', CAST(floor(CAST(x AS DOUBLE) * 127 + 128) AS INT))), '')) END AS pixels FROM embeddings""")
def read_images(t):
    """Each embedding as a grey 8 x 8 PNG file, decoded again; every thirteenth file is broken and stays a row."""
    images = readers.read_images(t.spark, _image_files(t, "true", "id % 13 = 5"), keep_failed=True)
    return images.select(
        F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("id"), c("height").isNull().alias("failed"), "height", "width",
        c("nChannels").alias("channels"), F.hex("data").alias("pixels"))


# ---- files to report ---------------------------------------------------------

_WANTED, _BROKEN = "id % 19 <> 7", "id % 13 = 5"
_FILE_PROBES = f"""file_probes AS (SELECT concat('id_', e.vec_id % 17, '/', e.vec_id, '.png') AS id,
  CASE WHEN e.vec_id % 10 <> 9 THEN e.label END AS identity_gt, s.image_id IS NOT NULL AS has_pred, s.v AS embedding
FROM embeddings e LEFT JOIN (SELECT image_id, [{", ".join(_EMBEDDING)}] AS v FROM scored
  WHERE NOT ({_BROKEN.replace("id", "image_id")}) AND {_WANTED.replace("id", "image_id")}) s ON e.vec_id = s.image_id)"""


def _of_files(*parts: str) -> list[str]:
    return [x.replace("fx_probes", "file_probes") for x in parts]


def _file_benchmark(t, output: str):
    truth = t.items.select(
        F.concat(F.lit("id_"), c("id") % 17, F.lit("/"), "id", F.lit(".png")).alias("image_path"),
        F.when(c("id") % 10 != 9, c("label")).alias("identity_label"))
    return run_benchmark(
        t.spark, truth, _image_files(t, _WANTED, _BROKEN), output, load_detector, load_embedder, load_keypoints, k=5)


@query("file_benchmark", with_views(*_of_files(
    "SELECT metric, k, value FROM report"), *SCORED, _FILE_PROBES, *_of_files(*EVALUATED, TARS, REPORT)))
def file_benchmark(t):
    """Image files, some broken and some missing, scored, ranked and reported."""
    report = _file_benchmark(t, scratch_dir(t.spark, "file-benchmark"))
    return report.withColumn("value", F.round("value", 6))


@query("file_benchmark_results", with_views(*_of_files("""
SELECT r.id, gt AS has_animal_gt, pred AS has_animal_pred, r.identity_gt, detection_correct, r.identity_rank, m.rn AS rank,
  m.b AS match_id, round(m.s, 6) AS similarity
FROM results r LEFT JOIN (SELECT * FROM granked WHERE rn <= 5) m ON r.id = m.a"""), *SCORED, _FILE_PROBES, *_of_files(*EVALUATED)))
def file_benchmark_results(t):
    """The saved results of the same run, a row per match."""
    output = scratch_dir(t.spark, "file-benchmark")
    _file_benchmark(t, output)
    saved = t.spark.read.json(f"{output}/results", schema="""id string, has_animal_gt boolean, has_animal_pred boolean, identity_gt int,
        detection_correct boolean, identity_rank long, similar_images array<struct<id: string, similarity: double>>""")
    kept = [k for k in saved.columns if k != "similar_images"]
    return saved.select(*kept, F.posexplode_outer("similar_images").alias("rank", "m")).select(
        *kept, (c("rank") + 1).cast("long").alias("rank"), c("m.id").alias("match_id"), F.round("m.similarity", 6).alias("similarity"))


@query("write_dataset_config", """
SELECT 'data' AS path, 'train.txt' AS train, 'val.txt' AS val, count(*) AS nc, string_agg(p_type, '|' ORDER BY p_partkey) AS names
FROM part WHERE p_partkey % 7 = 1""")
def write_dataset_config(t):
    """Descriptor of a dataset whose classes are some of the parts."""
    parts = t.read("part").filter("p_partkey % 7 = 1").select(c("p_partkey").alias("id"), c("p_type").alias("name"))
    path = scratch_dir(t.spark, "config")
    config = sinks.dataset_config(parts, "data", "train.txt", "val.txt")
    sinks.write_dataset_config(config, path)
    return t.spark.read.schema(config.schema).json(path).withColumn("names", F.array_join("names", "|"))
