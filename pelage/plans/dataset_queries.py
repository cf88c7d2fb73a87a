"""Queries of dataset preparation: joins, sets, splits, samples, statistics, training log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.functions import text as X
from pelage.operators import boxes as B
from pelage.operators import dataset as D
from pelage.operators import detection_eval as DE
from pelage.operators import splits as S
from pelage.operators import stats as T
from pelage.plans.bindings import with_views
from pelage.plans.geometry_queries import DOC_PATHS, doc_paths
from pelage.plans.registry import query

c = F.col

# ---- joins and filters ------------------------------------------------------

@query("join_boxes_images", with_views("SELECT ann_key, image_id, file_name, width, height FROM fx_sized"))
def join_boxes_images(t):
    return D.join_boxes_images(t.boxes, t.images).select("ann_key", "image_id", "file_name", "width", "height")


_DOG = "fx_boxes b WHERE category_id = 18"


def _dogs(t):
    return t.boxes.filter(c("category_id") == 18)


@query("join_labels_outer", with_views(f"""
SELECT i.image_id, d.ann_key FROM fx_images i LEFT JOIN (SELECT * FROM {_DOG}) d ON i.image_id = d.image_id"""))
def join_labels_outer(t):
    return D.join_labels_outer(t.images, _dogs(t)).select("image_id", "ann_key")


CATEGORIES = """cats AS (SELECT CAST(category_id AS BIGINT) AS id, max(class) AS name, CAST(category_id AS BIGINT) AS position
FROM fx_boxes GROUP BY category_id)"""


def categories_of(boxes):
    """Category table of the boxes; category 2 has no name."""
    found = boxes.groupBy(c("category_id").cast("long").alias("id")).agg(F.max("class").alias("name"))
    return found.withColumn("position", c("id"))


@query("category_lookup", with_views("""
SELECT coalesce(min(id), -1) AS category_id FROM cats WHERE name = 'dog'""", CATEGORIES))
def category_lookup(t):
    return D.category_lookup(categories_of(t.boxes))


SPLIT_IMAGES = """split_images AS (SELECT *, CASE WHEN rn <= floor(n * 0.9e0) THEN 'train' ELSE 'val' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (
    PARTITION BY source ORDER BY md5(concat_ws('|', '42', image_id)), image_id) AS rn FROM fx_images) s)"""


@query("image_split", with_views("SELECT image_id, source, split FROM split_images", SPLIT_IMAGES))
def image_split(t):
    return S.image_split(t.images).select("image_id", "source", "split")


@query("split_semi", with_views("""
SELECT ann_key, image_id FROM fx_boxes WHERE image_id IN (SELECT image_id FROM split_images WHERE split = 'val')""",
                                SPLIT_IMAGES))
def split_semi(t):
    return D.split_semi(t.boxes, S.image_split(t.images), "val").select("ann_key", "image_id")


_NEGATIVE = "SELECT image_id, file_name FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_boxes WHERE category_id = 18)"


@query("negatives_anti", with_views(_NEGATIVE))
def negatives_anti(t):
    return D.negatives_anti(t.images, _dogs(t)).select("image_id", "file_name")


@query("sample_negatives", with_views(f"""
SELECT image_id, file_name FROM ({_NEGATIVE}) n ORDER BY md5(concat_ws('|', '42', image_id)), image_id LIMIT 2000"""))
def sample_negatives(t):
    return D.sample_negatives(t.images, _dogs(t), 2000).select("image_id", "file_name")


@query("conflict_anti", with_views("""
SELECT image_id, identity FROM fx_identities
WHERE identity NOT IN (SELECT identity FROM fx_identities WHERE is_priority)"""))
def conflict_anti(t):
    return S.conflict_anti(t.identities, t.identities.filter("is_priority")).select("image_id", "identity")


@query("filter_multi_subject", with_views("""
SELECT image_id, ann_key FROM fx_boxes WHERE NOT coalesce(class = 'cat', false)"""))
def filter_multi_subject(t):
    entries = t.boxes.withColumn("is_multiple_dogs", c("class") == "cat")
    return D.filter_multi_subject(entries).select("image_id", "ann_key")


@query("filter_missing_images", with_views("""
SELECT ann_key, image_id FROM fx_sized WHERE file_name IN (
  SELECT file_name FROM fx_images WHERE width >= 400)"""))
def filter_missing_images(t):
    """The listing holds the wide images only."""
    files = t.images.filter(c("width") >= 400).select("file_name")
    return D.filter_missing_images(t.sized, files).select("ann_key", "image_id")


@query("filter_unlabelled", with_views("SELECT id, identity_gt AS identity_label FROM fx_probes WHERE identity_gt IS NOT NULL"))
def filter_unlabelled(t):
    return D.filter_unlabelled(t.probes.select("id", c("identity_gt").alias("identity_label")))


@query("filter_unlabelled_truthy", with_views("""
SELECT id, identity_gt AS identity_label FROM fx_probes WHERE identity_gt IS NOT NULL AND identity_gt <> 0"""))
def filter_unlabelled_truthy(t):
    items = t.probes.select("id", c("identity_gt").alias("identity_label"))
    return D.filter_unlabelled(items, truthy_labels=True)


@query("filter_placeholder_names", """
SELECT page_id, name FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('%s_', page_id) ELSE url END AS name FROM pages) p
WHERE NOT contains(name, '%s')""")
def filter_placeholder_names(t):
    name = F.when(c("page_id") % 5 == 0, F.concat(F.lit("%s_"), c("page_id"))).otherwise(c("url"))
    return D.filter_placeholder_names(t.read("pages").select("page_id", name.alias("name")), "name")


@query("filter_min_per_identity", with_views("""
SELECT image_id, identity FROM (SELECT *, count(*) OVER (PARTITION BY identity) AS n FROM fx_identities) i WHERE n >= 5"""))
def filter_min_per_identity(t):
    return S.filter_min_per_identity(t.identities).select("image_id", "identity")


# ---- lists and counts -------------------------------------------------------

@query("annotations_per_image", with_views("""
SELECT image_id, part, count(*) AS n_boxes, string_agg(ann_key, ',' ORDER BY ann_key) AS boxes
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY image_id ORDER BY ann_key) - 1) / 4.0e0) AS BIGINT) AS part FROM fx_boxes) b
GROUP BY image_id, part"""))
def annotations_per_image(t):
    """Lists of four boxes, so that many images have two."""
    listed = D.annotations_per_image(t.boxes.select("image_id", "ann_key", "x", "y", "w", "h"), size=4)
    keys = F.array_join(F.transform("boxes", lambda b: b["ann_key"]), ",")
    return listed.withColumn("boxes", keys)


@query("annotated_image_counts", with_views(f"""
SELECT count(*) AS n_images, count(d.image_id) AS n_with_annotations, count(*) - count(d.image_id) AS n_empty_labels
FROM fx_images i LEFT JOIN (SELECT DISTINCT image_id FROM {_DOG}) d ON i.image_id = d.image_id"""))
def annotated_image_counts(t):
    return T.annotated_image_counts(t.images, _dogs(t))


@query("identity_sizes", with_views("SELECT identity, count(*) AS n_images FROM fx_identities GROUP BY identity"))
def identity_sizes(t):
    return T.identity_sizes(t.identities)


_SIZES = "(SELECT identity, count(*) AS n_images FROM fx_identities GROUP BY identity) s"


@query("identity_size_histogram", with_views(f"SELECT n_images, count(*) AS n_identities FROM {_SIZES} GROUP BY n_images"))
def identity_size_histogram(t):
    return T.identity_size_histogram(t.identities)


@query("identity_size_summary", with_views(f"""
SELECT count(*) AS n_identities, min(n_images) AS min_images, max(n_images) AS max_images,
  round(avg(n_images), 6) AS mean_images, median(n_images) AS median_images FROM {_SIZES}"""))
def identity_size_summary(t):
    return T.identity_size_summary(t.identities).withColumn("mean_images", F.round("mean_images", 6))


def _distribution_sql(sources) -> str:
    whens = " ".join(f"WHEN contains(path, '{m}') THEN '{n}'" for m, n in sources)
    return with_views(f"""SELECT source, count(*) AS n, count(*) * 100.0e0 / (SELECT count(*) FROM doc_paths) AS percent
FROM (SELECT CASE {whens} ELSE 'Other' END AS source FROM doc_paths) p GROUP BY source""", DOC_PATHS)


@query("source_distribution", _distribution_sql(X.IDENTITY_SOURCES))
def source_distribution(t):
    return T.source_distribution(doc_paths(t), "path", X.IDENTITY_SOURCES)


@query("source_distribution_detection", _distribution_sql(X.DETECTION_SOURCES))
def source_distribution_detection(t):
    return T.source_distribution(doc_paths(t), "path", X.DETECTION_SOURCES)


@query("dataset_statistics", with_views("""
SELECT (SELECT count(*) FROM fx_images) AS num_images, count(*) AS num_annotations,
  count(DISTINCT category_id) AS num_categories, false AS has_keypoints FROM fx_boxes"""))
def dataset_statistics(t):
    return T.dataset_statistics(t.images, t.boxes, categories_of(t.boxes))


@query("num_classes", "SELECT CAST(max(label) + 1 AS BIGINT) AS num_classes FROM embeddings")
def num_classes(t):
    return T.num_classes(t.items)


@query("distinct_identities", with_views("SELECT count(DISTINCT identity) AS n_identities FROM fx_identities"))
def distinct_identities(t):
    return T.distinct_identities(t.identities, "identity")


# ---- identity splits --------------------------------------------------------

IDENTITY_SPLIT = """identity_sizes AS (SELECT identity, count(*) AS n_images FROM fx_identities GROUP BY identity HAVING count(*) >= 5),
filling AS (SELECT *, CAST(coalesce(sum(n_images) OVER (ORDER BY md5(concat_ws('|', '42', identity)), identity
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  (SELECT floor(sum(n_images) * 0.15e0) FROM identity_sizes) AS target FROM identity_sizes),
identity_splits AS (SELECT identity, n_images, CASE WHEN before < target THEN 'test'
  WHEN before - (SELECT sum(n_images) FROM filling WHERE before < target) < target THEN 'val' ELSE 'train' END AS split
  FROM filling)"""


@query("identity_split", with_views("SELECT identity, n_images, split FROM identity_splits", IDENTITY_SPLIT))
def identity_split(t):
    return S.identity_split(t.identities)


def _split_identities(t):
    return t.identities.join(S.identity_split(t.identities).select("identity", "split"), "identity")


@query("split_report", with_views("""
SELECT split, CAST(sum(n_images) AS BIGINT) AS n_images, count(*) AS n_identities FROM identity_splits GROUP BY split""",
                                  IDENTITY_SPLIT))
def split_report(t):
    return T.split_report(_split_identities(t))


@query("split_leakage", with_views("""
SELECT identity, count(DISTINCT split) AS n_splits FROM (
  SELECT identity, CASE WHEN image_id % 7 = 0 THEN 'val' ELSE 'train' END AS split FROM fx_identities) s
GROUP BY identity HAVING count(DISTINCT split) > 1"""))
def split_leakage(t):
    """A split by image, which leaks; the split by identity is tested to leak nothing."""
    by_image = t.identities.withColumn("split", F.when(c("image_id") % 7 == 0, "val").otherwise("train"))
    return S.split_leakage(by_image)


@query("dense_label_ids", with_views("""
SELECT identity, row_number() OVER (ORDER BY identity) - 1 AS label FROM (SELECT DISTINCT identity FROM fx_identities) i"""))
def dense_label_ids(t):
    return S.dense_label_ids(t.identities)


@query("sequential_ids", with_views("""
SELECT ann_key, split, row_number() OVER (ORDER BY split, md5(concat_ws('|', '0', ann_key)), ann_key) - 1 AS annotation_id
FROM fx_boxes b JOIN split_images i ON b.image_id = i.image_id""", SPLIT_IMAGES))
def sequential_ids(t):
    boxes = t.boxes.join(S.image_split(t.images).select("image_id", "split"), "image_id")
    return S.sequential_ids(boxes.select("ann_key", "split"), "ann_key")


# ---- caps and samples -------------------------------------------------------

@query("limit_per_identity", with_views("""
SELECT image_id, identity FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY image_id) AS rn
FROM fx_identities) i WHERE rn <= 3"""))
def limit_per_identity(t):
    return S.limit_per_identity(t.identities, 3, "image_id").select("image_id", "identity")


_PRIORITY_SAMPLE = """SELECT image_id, identity FROM (SELECT *, row_number() OVER (
  PARTITION BY identity ORDER BY md5(concat_ws('|', '42', image_id)), image_id) AS rn
FROM fx_identities WHERE is_priority) i WHERE rn <= 3"""


@query("sample_per_identity", with_views(_PRIORITY_SAMPLE))
def sample_per_identity(t):
    return S.sample_per_identity(t.identities.filter("is_priority"), 3, "image_id").select("image_id", "identity")


@query("sample_n", with_views("""
SELECT image_id FROM fx_images ORDER BY md5(concat_ws('|', '42', image_id)), image_id LIMIT 1000"""))
def sample_n(t):
    return S.sample_n(t.images, 1000, "image_id").select("image_id")


_BASE_CAPPED = """SELECT image_id, identity FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY image_id) AS rn
  FROM fx_identities WHERE NOT is_priority AND identity NOT IN (SELECT identity FROM fx_identities WHERE is_priority)) b
WHERE rn <= 3"""


@query("augmented_eval_set", with_views(f"""
SELECT image_id, identity, is_priority FROM (
  SELECT *, true AS is_priority FROM ({_PRIORITY_SAMPLE}) p
  UNION ALL SELECT *, false AS is_priority FROM ({_BASE_CAPPED}) b) u
ORDER BY is_priority DESC, md5(concat_ws('|', '42', image_id)), image_id LIMIT 2500"""))
def augmented_eval_set(t):
    base = t.identities.filter(~c("is_priority")).drop("is_priority")
    priority = t.identities.filter("is_priority").drop("is_priority")
    return S.augmented_eval_set(base, priority, 2500, 3).select("image_id", "identity", "is_priority")


# ---- sets -------------------------------------------------------------------

@query("union_sources", with_views("""
SELECT file_name, width, CAST(NULL AS VARCHAR) AS identity FROM fx_images
UNION ALL SELECT file_path, NULL, identity FROM fx_identities"""))
def union_sources(t):
    images = t.images.select("file_name", "width")
    return D.union_sources(images, t.identities.select(c("file_path").alias("file_name"), "identity"))


@query("dedupe_images", with_views("""
SELECT file_name, min(image_id) AS image_id FROM (
  SELECT image_id, concat(source, '/', width, '.jpg') AS file_name FROM fx_images) i GROUP BY file_name"""))
def dedupe_images(t):
    """Many images share a path made of source and width."""
    images = t.images.select("image_id", F.concat("source", F.lit("/"), "width", F.lit(".jpg")).alias("file_name"))
    return D.dedupe_images(images)


# ---- runs and training log --------------------------------------------------

@query("latest_run", with_views("""
SELECT arg_max(name, n) AS run_name, max(n) AS run_number FROM (
  SELECT name, CAST(regexp_extract(name, '^click_run([0-9]+)$', 1) AS BIGINT) AS n FROM fx_runs
  WHERE regexp_matches(name, '^click_run[0-9]+$')) r"""))
def latest_run(t):
    return T.latest_run(t.runs, "click_run")


@query("latest_timestamped_run", with_views("""
SELECT name AS run_name FROM fx_runs ORDER BY modified DESC, name DESC LIMIT 1"""))
def latest_timestamped_run(t):
    return T.latest_timestamped_run(t.runs)


_HISTORY = """h1 AS (SELECT run_id, epoch, phase, coalesce(map_score, 0.0e0) AS map_score,
  greatest(-1.0e0, coalesce(max(map_score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0e0)) AS best,
  greatest(-1.0e0, coalesce(max(map_score) OVER (PARTITION BY run_id, phase ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0e0)) AS pbest,
  row_number() OVER (PARTITION BY run_id, phase ORDER BY epoch) AS pos FROM fx_history),
h2 AS (SELECT *, map_score > best AS is_best, greatest(best, map_score) AS best_so_far, greatest(pbest, map_score) AS phase_best,
  pos - coalesce(max(CASE WHEN map_score > pbest THEN pos END) OVER (PARTITION BY run_id, phase ORDER BY epoch), 0) AS patience_used FROM h1),
h3 AS (SELECT *, patience_used >= 10 AND count(*) FILTER (WHERE patience_used >= 10) OVER (
  PARTITION BY run_id, phase ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS early_stop FROM h2)"""


@query("training_history", with_views("""
SELECT run_id, epoch, phase, map_score, is_best, best_so_far, phase_best, patience_used, early_stop FROM h3""", _HISTORY))
def training_history(t):
    return T.training_history(t.history)


@query("best_checkpoint", with_views("""
SELECT run_id, arg_max(epoch, map_score) AS best_epoch, max(map_score) AS best_map FROM h3 WHERE is_best GROUP BY run_id""",
                                     _HISTORY))
def best_checkpoint(t):
    return T.best_checkpoint(t.history)


# ---- detector quality -------------------------------------------------------
# Ground truth: valid boxes of category 18. Predictions: all valid detections, moved by
# 0 to 7 pixels taken from their key.

_PREDICTIONS = """preds AS (SELECT ann_key AS pred_key, image_id, CAST(x1 + j AS DOUBLE) AS x1, CAST(y1 + j AS DOUBLE) AS y1,
  CAST(x2 + j AS DOUBLE) AS x2, CAST(y2 + j AS DOUBLE) AS y2, confidence
FROM (SELECT *, instr('01234567', substr(translate(ann_key, '89abcdef', '01234567'), 1, 1)) - 1 AS j FROM fx_detections) d
WHERE x2 > x1 AND y2 > y1)"""
_TRUTH = """truth AS (SELECT ann_key AS gt_key, image_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
  CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM fx_detections
WHERE class = 'dog' AND x2 > x1 AND y2 > y1)"""
_MATCHES = """box_pairs AS (SELECT pred_key, gt_key, confidence, inter / (pa + ga - inter) AS iou FROM (
  SELECT p.pred_key, g.gt_key, p.confidence, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga,
    greatest(0.0e0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0.0e0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter
  FROM preds p JOIN truth g ON p.image_id = g.image_id) o),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_key ORDER BY iou DESC, gt_key) AS rn
  FROM box_pairs WHERE iou >= 0.5e0) m WHERE rn = 1)"""
_LEVELS = ", ".join(f"(CAST({v} AS DOUBLE))" for v in DE.IOU_LEVELS)
_CURVE = f"""levels AS (SELECT level FROM (VALUES {_LEVELS}) l(level)),
hits AS (SELECT level, confidence, count(*) AS tp FROM (
  SELECT level, confidence, row_number() OVER (PARTITION BY gt_key, level ORDER BY confidence DESC, pred_key) AS rn
  FROM matched, levels WHERE iou >= level) h WHERE rn = 1 GROUP BY level, confidence),
curve AS (SELECT level, confidence, tp * 1.0e0 / n AS precision, tp * 1.0e0 / (SELECT count(*) FROM truth) AS recall FROM (
  SELECT l.level, k.confidence, sum(coalesce(h.tp, 0)) OVER w AS tp, sum(k.n) OVER w AS n
  FROM (SELECT confidence, count(*) AS n FROM preds GROUP BY confidence) k CROSS JOIN levels l
  LEFT JOIN hits h ON h.level = l.level AND h.confidence = k.confidence
  WINDOW w AS (PARTITION BY l.level ORDER BY k.confidence DESC)) t)"""
_AP = """envelope AS (SELECT level, confidence, recall, max(precision) OVER (PARTITION BY level ORDER BY confidence
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM curve),
points AS (SELECT level, 0 AS o, 2.0e0 AS confidence, 0.0e0 AS r, 1.0e0 AS p FROM levels
  UNION ALL SELECT level, 1, confidence, recall, p FROM envelope
  UNION ALL SELECT level, 2, -1.0e0, 1.0e0, 0.0e0 FROM levels),
segments AS (SELECT level, r AS r0, p AS p0, lead(r) OVER w AS r1, lead(p) OVER w AS p1 FROM points
  WINDOW w AS (PARTITION BY level ORDER BY o, confidence DESC)),
ap AS (SELECT level, sum(CASE WHEN i = 0 THEN v / 2 ELSE v END) / 100 AS ap FROM (
  SELECT s.level, i, p0 + (i / 100.0e0 - r0) / (r1 - r0) * (p1 - p0) AS v
  FROM segments s JOIN range(0, 100) g(i) ON i / 100.0e0 >= r0 - 1e-11 AND i / 100.0e0 < r1 - 1e-11) x GROUP BY level)"""
_DETECTOR = (_PREDICTIONS, _TRUTH, _MATCHES, _CURVE)


def _detector(t):
    valid = t.detections.filter((c("x2") > c("x1")) & (c("y2") > c("y1")))
    corners = ("x1", "y1", "x2", "y2")
    jitter = F.expr("instr('01234567', substr(translate(ann_key, '89abcdef', '01234567'), 1, 1)) - 1")
    predictions = valid.select(
        c("ann_key").alias("pred_key"), "image_id", "confidence",
        *[(c(k) + jitter).cast("double").alias(k) for k in corners])
    truth = valid.filter(c("class") == "dog").select(
        c("ann_key").alias("gt_key"), "image_id", *[c(k).cast("double").alias(k) for k in corners])
    return predictions, truth


@query("match_boxes", with_views("SELECT pred_key, confidence, gt_key, iou FROM matched", *_DETECTOR[:3]))
def match_boxes(t):
    return DE.match_boxes(*_detector(t))


@query("precision_recall_curve", with_views("SELECT level, confidence, precision, recall FROM curve", *_DETECTOR))
def precision_recall_curve(t):
    return DE.precision_recall_curve(*_detector(t))


@query("detection_eval", with_views("""
SELECT round((SELECT ap FROM ap WHERE level = 0.5e0), 6) AS map50, round((SELECT avg(ap) FROM ap), 6) AS map50_95,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve WHERE level = 0.5e0
ORDER BY 2 * precision * recall / (precision + recall + 1e-16) DESC, confidence DESC LIMIT 1""", *_DETECTOR, _AP))
def detection_eval(t):
    df = DE.detection_eval(*_detector(t))
    return df.select(*[F.round(k, 6).alias(k) for k in df.columns])
