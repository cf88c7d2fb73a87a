"""Batch scoring with stand-in models over 8 x 8 images made of the embeddings.

Pixel i of image v is floor(128 + 127 e_i). The models are deterministic
functions of the pixels, so that SQL can follow them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pelage.operators import inference as I
from pelage.plans.bindings import with_views
from pelage.plans.registry import query

c = F.col

SIDE = 8


def pixel_hex(vector):
    return F.array_join(F.transform(
        vector, lambda x: F.lpad(F.hex(F.floor(x.cast("double") * 127 + 128).cast("long")), 2, "0")), "")


def images(t):
    """``image_id, height, width, nChannels, data`` like the image source gives it."""
    return t.items.select(
        c("id").alias("image_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.lit(1).alias("nChannels"), F.unhex(pixel_hex(c("embedding"))).alias("data"))


def load_detector():
    """Two boxes per image, in 640 x 640 input pixels, from ten sums that together take every pixel."""
    def predict(batch):
        answers = []
        for image in batch:
            p = image.reshape(-1).astype(int)
            sums = [int(p[j::10].sum()) for j in range(10)]
            rows = []
            for k in (0, 5):
                x, y = sums[k] % 4 * 80, sums[k + 1] % 4 * 80
                rows.append([float(x), float(y), float(x + 80 * (1 + sums[k + 2] % 4)),
                             float(y + 80 * (1 + sums[k + 3] % 4)), sums[k + 4] % 256 / 255.0, 0.0])
            answers.append(rows)
        return answers

    return predict


def load_keypoints():
    """Two instances per crop from the sum of its pixels; a third row is too short and skipped."""
    def predict(batch):
        answers = []
        for crop in batch:
            f = int(crop.astype(int).sum()) % 256
            rows = []
            for j in (0, 1):
                points = []
                for i in range(4):
                    points += [100.0 * i + 150.0 * j, 60.0 * i + 90.0 * j, 0.9 if f % (i + 2) else 0.2]
                rows.append([0.0, 0.0, 0.0, 0.0, ((f + j * 37) % 256) / 255.0, 0.0, *points])
            answers.append([*rows, [0.0, 0.0]])
        return answers

    return predict


def load_embedder():
    """Height and width of the crop, then the sums of its rows and of its columns."""
    def predict(batch):
        answers = []
        for crop in batch:
            pixels = crop.reshape(crop.shape[:2]).astype(np.float32)
            out = np.zeros(2 + 2 * SIDE, np.float32)
            out[:2] = pixels.shape
            out[2:2 + pixels.shape[0]] = pixels.sum(1)
            out[2 + SIDE:2 + SIDE + pixels.shape[1]] = pixels.sum(0)
            answers.append(out)
        return answers

    return predict


# ---- SQL twins --------------------------------------------------------------

_PX = """px AS (SELECT image_id, p, list_transform(range(1, 11), lambda j: list_sum(p[j:64:10])) AS s FROM (
  SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 127 + 128) AS INT)) AS p FROM embeddings) e)"""


def _raw_sql(k: int, pos: int) -> str:
    return f"""SELECT image_id, p, {pos} AS pos, s[{k + 1}] % 4 * 80 AS rx, s[{k + 2}] % 4 * 80 AS ry,
  80 * (1 + s[{k + 3}] % 4) AS rw, 80 * (1 + s[{k + 4}] % 4) AS rh, s[{k + 5}] % 256 / 255.0e0 AS confidence FROM px"""


_DETECTIONS = f"""raw AS ({_raw_sql(0, 0)} UNION ALL {_raw_sql(5, 1)}),
found AS (SELECT image_id, p, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1 AS INT) AS pos,
  CAST(trunc(rx * 8 / 640.0e0) AS BIGINT) AS x1, CAST(trunc(ry * 8 / 640.0e0) AS BIGINT) AS y1,
  CAST(trunc((rx + rw) * 8 / 640.0e0) AS BIGINT) AS x2, CAST(trunc((ry + rh) * 8 / 640.0e0) AS BIGINT) AS y2, confidence
  FROM raw WHERE confidence >= 0.1e0)"""


@query("detect_batch", with_views(
    "SELECT image_id, pos, x1, y1, x2, y2, confidence, 'dog' AS class FROM found", _PX, _DETECTIONS))
def detect_batch(t):
    df = I.detect_batch(images(t), load_detector)
    return df.select("image_id", F.explode("detections").alias("d")).select(
        "image_id", "d.pos", "d.x1", "d.y1", "d.x2", "d.y2", "d.confidence", "d.class")


_CROPS = """crops AS (SELECT image_id, p, image_id % 3 AS cx1, image_id % 2 AS cy1, 8 - image_id % 4 AS cx2, 5 + image_id % 4 AS cy2 FROM px)"""


def window(t):
    """The images with a crop each that depends on their id."""
    i = c("image_id")
    return images(t).withColumn("crop", F.struct(
        (i % 3).alias("x1"), (i % 2).alias("y1"), (SIDE - i % 4).alias("x2"), (i % 4 + 5).alias("y2")))


def _sum_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    """Sum of the pixels in a window."""
    inside = f"i // 8 >= {y1} AND i // 8 < {y2} AND i % 8 >= {x1} AND i % 8 < {x2}"
    return f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN {inside} THEN p[i + 1] ELSE 0 END))"


def _embedding_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    """The embedder's numbers ``e0 .. e17`` of a window."""
    rows = [_sum_sql(x1, f"{y1} + {r}", x2, f"least({y2}, {y1} + {r + 1})") for r in range(SIDE)]
    cols = [_sum_sql(f"{x1} + {r}", y1, f"least({x2}, {x1} + {r + 1})", y2) for r in range(SIDE)]
    return ", ".join(f"CAST({v} AS DOUBLE) AS e{i}" for i, v in enumerate([f"({y2} - {y1})", f"({x2} - {x1})", *rows, *cols]))


def _instances_sql(crops: str) -> str:
    parts = []
    for j in (0, 1):
        points = ", ".join(
            f"{100.0 * i + 150.0 * j}e0 * (cx2 - cx1) / 640.0e0 AS k{i}_x, "
            f"{60.0 * i + 90.0 * j}e0 * (cy2 - cy1) / 640.0e0 AS k{i}_y, "
            f"CASE WHEN f % {i + 2} <> 0 THEN 0.9e0 ELSE 0.2e0 END AS k{i}_v" for i in range(4))
        parts.append(f"SELECT *, {j} AS ipos, ((f + {j * 37}) % 256) / 255.0e0 AS iconf, {points} FROM cropped")
    return f"""cropped AS (SELECT *, {_sum_sql('cx1', 'cy1', 'cx2', 'cy2')} % 256 AS f FROM {crops}),
instances AS ({' UNION ALL '.join(parts)})"""


_POINTS = [f"k{i}_{p}" for i in range(4) for p in "xyv"]


@query("keypoints_batch", with_views(
    f"SELECT image_id, CAST(ipos AS INT) AS pos, iconf AS confidence, {', '.join(_POINTS)} FROM instances",
    _PX, _CROPS, _instances_sql("crops")))
def keypoints_batch(t):
    df = I.keypoints_batch(window(t), load_keypoints)
    return df.select("image_id", F.explode("instances").alias("i")).select(
        "image_id", "i.pos", "i.confidence",
        *[c("i.keypoints")[i][p].alias(f"k{i}_{p}") for i in range(4) for p in ("x", "y", "v")])


_EMBEDDING = [f"e{i}" for i in range(2 + 2 * SIDE)]


def _embedding_columns(e):
    return [e[i].cast("double").alias(k) for i, k in enumerate(_EMBEDDING)]


@query("embed_batch", with_views(f"SELECT image_id, {_embedding_sql('cx1', 'cy1', 'cx2', 'cy2')} FROM crops", _PX, _CROPS))
def embed_batch(t):
    return I.embed_batch(window(t), load_embedder).select("image_id", *_embedding_columns(c("embedding")))


_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pos) AS rn
  FROM found WHERE confidence >= 0.5e0) b WHERE rn = 1),
crops AS (SELECT image_id, p, greatest(0, x1 - pad) AS cx1, greatest(0, y1 - pad) AS cy1, least(8, x2 + pad) AS cx2,
  least(8, y2 + pad) AS cy2 FROM (SELECT *, CAST(trunc((x2 - x1) * 0.1e0) AS BIGINT) AS pad FROM best) b)"""
_SCORED = f"""{_BEST},
{_instances_sql('crops')},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iconf DESC, ipos) AS rn FROM instances) i
  WHERE rn = 1),
fine AS (SELECT image_id, p, CASE WHEN sure THEN cx1 + greatest(0, a - pad) ELSE cx1 END AS wx1,
    CASE WHEN sure THEN cy1 + greatest(0, b - pad) ELSE cy1 END AS wy1,
    CASE WHEN sure THEN cx1 + least(cx2 - cx1, q + pad) ELSE cx2 END AS wx2,
    CASE WHEN sure THEN cy1 + least(cy2 - cy1, r + pad) ELSE cy2 END AS wy2
  FROM (SELECT *, CAST(trunc((q - a) * 0.2e0) AS BIGINT) AS pad FROM (
    SELECT *, k0_v > 0.3e0 AND k1_v > 0.3e0 AND k2_v > 0.3e0 AND k3_v > 0.3e0 AS sure,
      CAST(trunc(least(k0_x, k1_x, k2_x, k3_x)) AS BIGINT) AS a, CAST(trunc(least(k0_y, k1_y, k2_y, k3_y)) AS BIGINT) AS b,
      CAST(trunc(greatest(k0_x, k1_x, k2_x, k3_x)) AS BIGINT) AS q,
      CAST(trunc(greatest(k0_y, k1_y, k2_y, k3_y)) AS BIGINT) AS r FROM chosen) m) n),
scored AS (SELECT image_id, wx1, wy1, wx2, wy2, {_embedding_sql('wx1', 'wy1', 'wx2', 'wy2')} FROM fine WHERE wx2 > wx1 AND wy2 > wy1)"""
SCORED = (_PX, _DETECTIONS, _SCORED)


def _scored(t):
    return I.score_images(images(t), load_detector, load_embedder, load_keypoints)


@query("score_images", with_views(f"""
SELECT i.image_id, wx1 AS x1, wy1 AS y1, wx2 AS x2, wy2 AS y2, {", ".join(_EMBEDDING)}
FROM px i LEFT JOIN scored s ON i.image_id = s.image_id""", *SCORED))
def score_images(t):
    return _scored(t).select("image_id", "crop.*", *_embedding_columns(c("embedding")))


@query("build_gallery", with_views(f"SELECT image_id, {', '.join(_EMBEDDING)} FROM scored", *SCORED))
def build_gallery(t):
    return I.build_gallery(_scored(t)).select("image_id", *_embedding_columns(c("embedding")))


@query("classify_image_batch", with_views("""
SELECT i.image_id, CASE WHEN b.image_id IS NULL THEN 'no_animal' ELSE 'dog' END AS animal_class
FROM px i LEFT JOIN best b ON i.image_id = b.image_id""", _PX, _DETECTIONS, _BEST))
def classify_image_batch(t):
    return I.classify_images(images(t), load_detector).select("image_id", "animal_class")


_TWO_STAGE = f"""dcrops AS (SELECT *, greatest(0, x1 - px) AS cx1, greatest(0, y1 - py) AS cy1, least(8, x2 + px) AS cx2,
  least(8, y2 + py) AS cy2 FROM (SELECT *, CAST(trunc((x2 - x1) * 0.2e0) AS BIGINT) AS px,
    CAST(trunc((y2 - y1) * 0.2e0) AS BIGINT) AS py FROM found WHERE confidence >= 0.5e0) d),
{_instances_sql('dcrops')},
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pos ORDER BY
    sqrt(dx * dx + dy * dy), ipos) AS rn FROM (
    SELECT *, (least(k0_x, k1_x, k2_x, k3_x) + greatest(k0_x, k1_x, k2_x, k3_x)) / 2 + cx1 - (x1 + x2) / 2.0e0 AS dx,
      (least(k0_y, k1_y, k2_y, k3_y) + greatest(k0_y, k1_y, k2_y, k3_y)) / 2 + cy1 - (y1 + y2) / 2.0e0 AS dy
    FROM instances) a) b WHERE rn = 1)"""


@query("two_stage_inference", with_views(f"""
SELECT image_id, pos, x1, y1, x2, y2, confidence, {', '.join(
    f'CAST(trunc(k{i}_x + cx1) AS BIGINT) AS k{i}_x, CAST(trunc(k{i}_y + cy1) AS BIGINT) AS k{i}_y' for i in range(4))}
FROM nearest""", _PX, _DETECTIONS, _TWO_STAGE))
def two_stage_inference(t):
    df = I.two_stage_inference(images(t), load_detector, load_keypoints)
    return df.select(
        "image_id", "pos", "x1", "y1", "x2", "y2", "confidence",
        *[c("keypoints")[i][p].alias(f"k{i}_{p}") for i in range(4) for p in ("x", "y")])
