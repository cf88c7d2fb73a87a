"""Queries over boxes, crops, keypoints and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.functions import geometry as G
from pelage.functions import text as X
from pelage.operators import boxes as B
from pelage.operators import dataset as D
from pelage.plans.bindings import with_views
from pelage.plans.registry import query

c = F.col

CLEAN = """
SELECT image_id, ann_key, round(greatest(0.0e0, x), 2) AS x, round(greatest(0.0e0, y), 2) AS y,
       round(least(CAST(width AS DOUBLE), x + w) - greatest(0.0e0, x), 2) AS w,
       round(least(CAST(height AS DOUBLE), y + h) - greatest(0.0e0, y), 2) AS h FROM fx_sized"""
_clean = f"SELECT image_id, ann_key, x, y, w, h, w * h AS area FROM ({CLEAN}) t WHERE w > 0 AND h > 0"
BOX = ["image_id", "ann_key", "x", "y", "w", "h"]


@query("voc_box_clean", with_views(_clean))
def voc_box_clean(t):
    corners = t.sized.select(
        "image_id", "ann_key", "width", "height", c("x").alias("xmin"), c("y").alias("ymin"),
        (c("x") + c("w")).alias("xmax"), (c("y") + c("h")).alias("ymax"))
    return B.voc_box_clean(corners).select(*BOX, "area")


@query("coco_box_clean", with_views(_clean))
def coco_box_clean(t):
    return B.coco_box_clean(t.sized).select(*BOX, "area")


_CLAMPED = """
SELECT image_id, ann_key, width, height, greatest(0, x) AS x, greatest(0, y) AS y,
       least(width, x + w) - greatest(0, x) AS w, least(height, y + h) - greatest(0, y) AS h FROM fx_sized"""


@query("yolo_box", with_views(f"""
SELECT image_id, ann_key, (x + w / 2) / width AS xc, (y + h / 2) / height AS yc, w / width AS w, h / height AS h
FROM ({_CLAMPED}) t WHERE w > 0 AND h > 0"""))
def yolo_box(t):
    return B.yolo_box(t.sized).select("image_id", "ann_key", "xc", "yc", "w", "h")


@query("yolo_box_clamped_report", with_views("""
SELECT image_id, ann_key, x, y, w, h, clamped_x, clamped_y, clamped_w, clamped_h FROM (
  SELECT *, CAST(greatest(0, x) AS DOUBLE) AS clamped_x, CAST(greatest(0, y) AS DOUBLE) AS clamped_y,
    least(width, x + w) - greatest(0, x) AS clamped_w, least(height, y + h) - greatest(0, y) AS clamped_h
  FROM fx_sized) t
WHERE clamped_x <> x OR clamped_y <> y OR clamped_x + clamped_w <> x + w OR clamped_y + clamped_h <> y + h"""))
def yolo_box_clamped_report(t):
    return B.yolo_box_clamped_report(t.sized).select(*BOX, *[f"clamped_{k}" for k in "xywh"])


@query("pose_box", with_views("""
SELECT image_id, ann_key, (x + w / 2) / width AS xc, (y + h / 2) / height AS yc, w / width AS w, h / height AS h
FROM fx_sized"""))
def pose_box(t):
    return B.pose_box(t.sized).select("image_id", "ann_key", "xc", "yc", "w", "h")


@query("yolo_to_pixels", with_views("""
SELECT image_id, ann_key, CAST(trunc((xc - w / 2) * width) AS BIGINT) AS x1,
  CAST(trunc((yc - h / 2) * height) AS BIGINT) AS y1, CAST(trunc((xc + w / 2) * width) AS BIGINT) AS x2,
  CAST(trunc((yc + h / 2) * height) AS BIGINT) AS y2
FROM (SELECT image_id, ann_key, width, height, (x + w / 2) / width AS xc, (y + h / 2) / height AS yc,
  w / width AS w, h / height AS h FROM fx_sized) t"""))
def yolo_to_pixels(t):
    keyed = B.pose_box(t.sized)
    return B.yolo_to_pixels(keyed).select("image_id", "ann_key", "x1", "y1", "x2", "y2")


@query("filter_invalid_boxes", with_views("SELECT image_id, ann_key, x, y, w, h FROM fx_boxes WHERE w > 0 AND h > 0"))
def filter_invalid_boxes(t):
    return B.filter_invalid_boxes(t.boxes).select(*BOX)


@query("images_with_valid_boxes", with_views(f"""
SELECT image_id, file_name FROM fx_images WHERE image_id IN (SELECT image_id FROM ({_clean}) v)"""))
def images_with_valid_boxes(t):
    return D.images_with_valid_boxes(t.images, B.coco_box_clean(t.sized)).select("image_id", "file_name")


# ---- crops ------------------------------------------------------------------

def _window_sql(x1: str, y1: str, x2: str, y2: str, px: str, py: str, w: str, h: str, keys: str, source: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN ok THEN a END AS crop_x1, CASE WHEN ok THEN b END AS crop_y1,
       CASE WHEN ok THEN p END AS crop_x2, CASE WHEN ok THEN q END AS crop_y2
FROM (SELECT *, p > a AND q > b AS ok FROM (
  SELECT *, CAST(greatest(0, {x1} - {px}) AS BIGINT) AS a, CAST(greatest(0, {y1} - {py}) AS BIGINT) AS b,
    CAST(least({w}, {x2} + {px}) AS BIGINT) AS p, CAST(least({h}, {y2} + {py}) AS BIGINT) AS q
  FROM (SELECT *, {_trunc('(x2 - x1) * 0.1e0')} AS pad, {_trunc('(x2 - x1) * 0.2e0')} AS padx,
    {_trunc('(y2 - y1) * 0.2e0')} AS pady FROM {source}) s) u) v"""


def _trunc(expr: str) -> str:
    return f"CAST(trunc({expr}) AS BIGINT)"


_WINDOW = ["crop_x1", "crop_y1", "crop_x2", "crop_y2"]


@query("detection_crop", with_views(_window_sql(
    "x1", "y1", "x2", "y2", "pad", "pad", "width", "height", "image_id, ann_key", "fx_detections")))
def detection_crop(t):
    return B.detection_crop(t.detections).select("image_id", "ann_key", *_WINDOW)


@query("crop_per_axis", with_views(_window_sql(
    "x1", "y1", "x2", "y2", "padx", "pady", "width", "height", "image_id, ann_key", "fx_detections")))
def crop_per_axis(t):
    return B.crop_per_axis(t.detections).select("image_id", "ann_key", *_WINDOW)


@query("keypoint_crop", with_views("""
SELECT image_id, ann_key, wx1 AS crop_x1, wy1 AS crop_y1, wx2 AS crop_x2, wy2 AS crop_y2,
  wx2 - wx1 AS crop_w, wy2 - wy1 AS crop_h, x - wx1 AS x, y - wy1 AS y, w, h, w * h AS area
FROM (
  SELECT *, greatest(0, x - CAST(trunc(w * 0.2e0) AS BIGINT)) AS wx1, greatest(0, y - CAST(trunc(h * 0.2e0) AS BIGINT)) AS wy1,
    least(width, x + w + CAST(trunc(w * 0.2e0) AS BIGINT)) AS wx2,
    least(height, y + h + CAST(trunc(h * 0.2e0) AS BIGINT)) AS wy2
  FROM (SELECT image_id, ann_key, width, height, x, y, least(w, width - x) AS w, least(h, height - y) AS h
    FROM (SELECT image_id, ann_key, width, height, greatest(0, CAST(trunc(x) AS BIGINT)) AS x,
      greatest(0, CAST(trunc(y) AS BIGINT)) AS y, CAST(trunc(w) AS BIGINT) AS w, CAST(trunc(h) AS BIGINT) AS h
      FROM fx_sized) a) b
  WHERE w > 0 AND h > 0) d
WHERE wx2 > wx1 AND wy2 > wy1"""))
def keypoint_crop(t):
    return B.keypoint_crop(t.sized).select(
        "image_id", "ann_key", *_WINDOW, "crop_w", "crop_h", "x", "y", "w", "h", "area")


@query("scale_detections", with_views(f"""
SELECT image_id, ann_key, {_trunc('x1 * width / 640.0e0')} AS x1, {_trunc('y1 * height / 480.0e0')} AS y1,
  {_trunc('x2 * width / 640.0e0')} AS x2, {_trunc('y2 * height / 480.0e0')} AS y2, confidence, 'dog' AS class
FROM fx_detections WHERE confidence >= 0.1e0"""))
def scale_detections(t):
    return B.scale_detections(t.detections, 640, 480).select(
        "image_id", "ann_key", "x1", "y1", "x2", "y2", "confidence", "class")


# ---- detections -------------------------------------------------------------

_CONFIDENT = "coalesce(class, 'dog') = 'dog' AND confidence >= 0.5e0"


@query("filter_confident_target", with_views(f"""
SELECT image_id, ann_key, confidence, class FROM fx_detections WHERE {_CONFIDENT}"""))
def filter_confident_target(t):
    return B.filter_confident_target(t.detections).select("image_id", "ann_key", "confidence", "class")


@query("best_detection", with_views(f"""
SELECT image_id, ann_key, confidence, x1, y1, x2, y2 FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, ann_key) AS rn
  FROM fx_detections WHERE {_CONFIDENT}) t WHERE rn = 1"""))
def best_detection(t):
    best = B.best_detection(B.filter_confident_target(t.detections))
    return best.select("image_id", "ann_key", "confidence", "x1", "y1", "x2", "y2")


@query("classify_image", with_views("""
SELECT i.image_id, CASE WHEN b.confidence >= 0.5e0 THEN coalesce(b.class, 'other') ELSE 'no_animal' END AS animal_class
FROM fx_images i LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, ann_key) AS rn FROM fx_detections) b
  ON i.image_id = b.image_id AND b.rn = 1"""))
def classify_image(t):
    return B.classify_image(t.images, t.detections)


@query("closest_instance", with_views("""
SELECT image_id, ann_key AS instance, distance FROM (
  SELECT d.image_id, k.ann_key, k.distance0 AS distance,
    row_number() OVER (PARTITION BY d.image_id ORDER BY k.distance0, k.ann_key) AS rn
  FROM (SELECT image_id, min(ann_key) AS det FROM fx_detections GROUP BY image_id) d
  JOIN (SELECT a.ann_key AS det, b.ann_key,
      sqrt(((b.x1 + b.x2) / 2.0e0 + 7 - (a.x1 + a.x2) / 2.0e0) * ((b.x1 + b.x2) / 2.0e0 + 7 - (a.x1 + a.x2) / 2.0e0)
         + ((b.y1 + b.y2) / 2.0e0 + 9 - (a.y1 + a.y2) / 2.0e0) * ((b.y1 + b.y2) / 2.0e0 + 9 - (a.y1 + a.y2) / 2.0e0)) AS distance0
    FROM fx_detections a JOIN fx_detections b ON a.image_id = b.image_id) k ON d.det = k.det) t
WHERE rn = 1"""))
def closest_instance(t):
    """Per image: its first detection, and the box that is nearest when shifted by an offset."""
    first = t.detections.groupBy("image_id").agg(
        F.min_by(F.struct("x1", "y1", "x2", "y2"), "ann_key").alias("d")).select(
        "image_id", "d.*", F.lit(7).alias("off_x"), F.lit(9).alias("off_y"))
    instances = t.detections.select(
        "image_id", c("ann_key").alias("pos"), *[c(k).alias(f"k{k}") for k in ("x1", "y1", "x2", "y2")])
    return B.closest_instance(first, instances, "image_id").select(
        "image_id", c("pos").alias("instance"), "distance")


# ---- keypoints --------------------------------------------------------------
# 21 joints of each embedding: x = 200 + 400 e[3i], y = 200 + 400 e[3i+1], visible if e[3i+2] > 0.

def _joints(t):
    e = c("embedding").cast("array<double>")
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(
        F.get(e, i * 3) * 400 + 200, F.get(e, i * 3 + 1) * 400 + 200,
        F.when(F.get(e, i * 3 + 2) > 0, 1.0).otherwise(0.0)))
    return t.items.select("id", joints.alias("joints"))


def _joint_sql(i: int) -> tuple[str, str, str]:
    e = [f"CAST(embedding[{3 * i + k + 1}] AS DOUBLE)" for k in range(3)]
    return f"({e[0]} * 400 + 200)", f"({e[1]} * 400 + 200)", f"({e[2]} > 0)"


def _flat(points, prefix: str = "k"):
    return [points[i][p].alias(f"{prefix}{i}_{p}") for i in range(4) for p in ("x", "y", "v")]


def _selected_sql(x_off: int, y_off: int) -> list[tuple[str, str, str]]:
    out = []
    for i in (16, 17, 14, 15):
        x, y, v = _joint_sql(i)
        out.append((f"CASE WHEN {v} THEN {x} - {x_off} ELSE 0.0e0 END",
                    f"CASE WHEN {v} THEN {y} - {y_off} ELSE 0.0e0 END",
                    f"CASE WHEN {v} THEN 1.0e0 ELSE 0.0e0 END"))
    return out


def _columns_sql(points, prefix: str = "k") -> str:
    return ", ".join(f"{e} AS {prefix}{i}_{p}" for i, point in enumerate(points) for p, e in zip("xyv", point))


@query("select_keypoints", f"SELECT vec_id AS id, {_columns_sql(_selected_sql(50, 60))} FROM embeddings")
def select_keypoints(t):
    df = _joints(t).withColumn("k", G.select_joints(c("joints"), F.lit(50), F.lit(60)))
    return df.select("id", *_flat(c("k")))


def _validated_sql() -> list[tuple[str, str, str]]:
    out = []
    for i in range(4):
        gone = f"(k{i}_v > 0 AND NOT (k{i}_x >= 0 AND k{i}_x < 180 AND k{i}_y >= 0 AND k{i}_y < 160))"
        out.append(tuple(f"CASE WHEN {gone} THEN 0.0e0 ELSE k{i}_{p} END" for p in "xyv"))
    return out


_SELECTED = f"(SELECT vec_id AS id, {_columns_sql(_selected_sql(50, 60))} FROM embeddings) s"


def _validated(t):
    df = _joints(t).withColumn("k", G.select_joints(c("joints"), F.lit(50), F.lit(60)))
    return df.select("id", G.validate_keypoints(c("k"), F.lit(180), F.lit(160)).alias("k"))


@query("validate_keypoints", f"SELECT id, {_columns_sql(_validated_sql())} FROM {_SELECTED}")
def validate_keypoints(t):
    return _validated(t).select("id", *_flat(c("k")))


_VALID = f"(SELECT id, {_columns_sql(_validated_sql())} FROM {_SELECTED}) v"


@query("count_visible", f"""SELECT id, CAST({' + '.join(f'(CASE WHEN k{i}_v > 0 THEN 1 ELSE 0 END)' for i in range(4))} AS BIGINT)
AS n_visible FROM {_VALID}""")
def count_visible(t):
    return _validated(t).select("id", G.count_visible(c("k")).alias("n_visible"))


_SOME = " + ".join(f"(CASE WHEN k{i}_v > 0 THEN 1 ELSE 0 END)" for i in range(4))


POSE_POINTS = f"""
SELECT id, {', '.join(f'''CASE WHEN n > 0 THEN k{i}_x / 180 ELSE 0.0e0 END AS k{i}_x,
CASE WHEN n > 0 THEN k{i}_y / 160 ELSE 0.0e0 END AS k{i}_y,
CASE WHEN n > 0 AND k{i}_v > 0 THEN 2.0e0 ELSE 0.0e0 END AS k{i}_v''' for i in range(4))}
FROM (SELECT *, {_SOME} AS n FROM {_VALID}) w"""


@query("pose_keypoints", POSE_POINTS)
def pose_keypoints(t):
    df = _validated(t)
    points = G.normalized_keypoints(c("k"), G.count_visible(c("k")), F.lit(180), F.lit(160))
    df = df.withColumn("p", points)
    return df.select("id", *[
        F.coalesce(c("p")[i][p], F.lit(0.0)).alias(f"k{i}_{p}") for i in range(4) for p in ("x", "y", "v")])


_RAW_STARTS = (0, 18, 36, 46)


@query("scale_keypoints", " UNION ALL ".join(f"""
SELECT vec_id AS id, {pos} AS pos, CAST(embedding[{at + 5}] AS DOUBLE) AS confidence, {', '.join(
    f'CAST(embedding[{at + 7 + 3 * i}] AS DOUBLE) * 400 / 640.0e0 AS k{i}_x, '
    f'CAST(embedding[{at + 8 + 3 * i}] AS DOUBLE) * 300 / 640.0e0 AS k{i}_y, '
    f'CAST(embedding[{at + 9 + 3 * i}] AS DOUBLE) AS k{i}_v' for i in range(4))} FROM embeddings"""
                                             for pos, at in enumerate(_RAW_STARTS)))
def scale_keypoints(t):
    """The 64 values as four raw rows of 18 (the last overlaps), and a row that is too short."""
    from pelage.operators.inference import scale_raw_keypoints

    values = c("embedding").cast("array<double>")
    raw = F.array(*[F.slice(values, at + 1, 18) for at in _RAW_STARTS], F.array(F.lit(1.0)))
    df = t.items.select("id", F.explode(scale_raw_keypoints(raw, F.lit(400), F.lit(300), 640, 640)).alias("i"))
    return df.select("id", "i.pos", "i.confidence", *_flat(c("i.keypoints")))


_XS = [f"k{i}_x" for i in range(4)]
_YS = [f"k{i}_y" for i in range(4)]


def _refine_sql() -> str:
    low_x, high_x = f"least({', '.join(_XS)})", f"greatest({', '.join(_XS)})"
    low_y, high_y = f"least({', '.join(_YS)})", f"greatest({', '.join(_YS)})"
    sure = " AND ".join(f"k{i}_v > 0.3e0" for i in range(4))
    return f"""
SELECT id, CASE WHEN ok THEN a END AS final_x1, CASE WHEN ok THEN b END AS final_y1,
  CASE WHEN ok THEN p END AS final_x2, CASE WHEN ok THEN q END AS final_y2
FROM (SELECT *, p > a AND q > b AS ok FROM (
  SELECT id, CASE WHEN sure THEN greatest(0, x1 - pad) ELSE 0 END AS a,
    CASE WHEN sure THEN greatest(0, y1 - pad) ELSE 0 END AS b,
    CASE WHEN sure THEN least(180, x2 + pad) ELSE 180 END AS p,
    CASE WHEN sure THEN least(160, y2 + pad) ELSE 160 END AS q
  FROM (SELECT *, {_trunc('(x2 - x1) * 0.2e0')} AS pad FROM (
    SELECT id, {sure} AS sure, {_trunc(low_x)} AS x1, {_trunc(low_y)} AS y1,
      {_trunc(high_x)} AS x2, {_trunc(high_y)} AS y2 FROM {_SELECTED}) r) m) n) o"""


@query("keypoint_refine_crop", _refine_sql())
def keypoint_refine_crop(t):
    df = _joints(t).select(
        "id", G.select_joints(c("joints"), F.lit(50), F.lit(60)).alias("keypoints"),
        F.lit(180).cast("long").alias("crop_w"), F.lit(160).cast("long").alias("crop_h"))
    return B.keypoint_refine_crop(df).select("id", "final_x1", "final_y1", "final_x2", "final_y2")


@query("uncrop_keypoints", f"""
SELECT id, {', '.join(f'{_trunc(f"k{i}_x + 50")} AS k{i}_x, {_trunc(f"k{i}_y + 60")} AS k{i}_y' for i in range(4))}
FROM {_VALID}""")
def uncrop_keypoints(t):
    df = _validated(t).withColumn("u", G.uncrop_keypoints(c("k"), F.lit(50), F.lit(60)))
    return df.select("id", *[c("u")[i][p].alias(f"k{i}_{p}") for i in range(4) for p in ("x", "y")])


# ---- paths ------------------------------------------------------------------

@query("label_path", with_views("""
SELECT image_id, regexp_replace(regexp_replace(concat(file_name, '/images.jpg'), '^(.*?)images', '\\1labels'),
  '\\.[^./]+$', '.txt') AS label_path,
  replace(replace(concat(file_name, '/images.jpg'), '/images/', '/labels/'), '.jpg', '.txt') AS label_path_all
FROM fx_images"""))
def label_path(t):
    path = F.concat(c("file_name"), F.lit("/images.jpg"))
    return t.images.select(
        "image_id", X.label_path(path).alias("label_path"), X.label_path_all(path).alias("label_path_all"))


_DOC_PATH = """CASE doc_id % 6 WHEN 0 THEN concat('data/dogfacenet/', source, '/', doc_id, '.jpg')
  WHEN 1 THEN concat('data/stanford_dogs/', source, '/', doc_id, '.jpg')
  WHEN 2 THEN concat('data/oxford_pets/stanford_dogs/', source, '/', doc_id, '.jpg')
  WHEN 3 THEN concat('data/additional_identities/', source, '/', doc_id, '.jpg')
  WHEN 4 THEN concat('coco/oxford_pets/', doc_id, '.jpg') ELSE concat('data/', source, '/', doc_id, '.jpg') END"""


def doc_paths(t):
    """Documents as image paths below differing source folders."""
    return t.read("documents").select("doc_id", F.expr(_DOC_PATH).alias("path"))


def _bucket_sql(sources) -> str:
    whens = " ".join(f"WHEN contains(path, '{marker}') THEN '{name}'" for marker, name in sources)
    return f"CASE {whens} ELSE 'Other' END"


DOC_PATHS = f"doc_paths AS (SELECT doc_id, {_DOC_PATH} AS path FROM documents)"


@query("source_bucket", with_views(f"""
SELECT doc_id, {_bucket_sql(X.IDENTITY_SOURCES)} AS identity_source, {_bucket_sql(X.DETECTION_SOURCES)} AS detection_source
FROM doc_paths""", DOC_PATHS))
def source_bucket(t):
    return doc_paths(t).select(
        "doc_id", X.source_bucket(c("path"), X.IDENTITY_SOURCES).alias("identity_source"),
        X.source_bucket(c("path"), X.DETECTION_SOURCES).alias("detection_source"))


@query("normalize_path", with_views("""
SELECT image_id, CASE WHEN starts_with(p, 'src1/') THEN substr(p, 6) ELSE p END AS path
FROM (SELECT image_id, replace(replace(file_name, '/', chr(92)), chr(92), '/') AS p FROM fx_images) t"""))
def normalize_path(t):
    backslashed = F.translate("file_name", "/", "\\")
    return t.images.select("image_id", X.normalize_path(backslashed, "src1").alias("path"))


@query("crop_file_name", with_views("""
SELECT ann_key, concat(i.image_id, '_', ann_key, '.jpg') AS file_name
FROM fx_boxes b JOIN fx_images i ON b.image_id = i.image_id"""))
def crop_file_name(t):
    return t.sized.select("ann_key", X.crop_file_name(c("file_name"), c("ann_key")).alias("file_name"))
