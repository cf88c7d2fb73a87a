"""Joins and set operations of annotation-dataset preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.operators.prefix import positions, unused
from pelage.operators.splits import sample_n

c = F.col

# Boxes of one image in one list.
LIST_ROWS = 1_000


def join_boxes_images(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes with the size and name of their image; orphans go."""
    return boxes.join(images, "image_id")


def join_labels_outer(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with each of their boxes, or once without."""
    return images.join(boxes, "image_id", "left")


def category_lookup(categories: DataFrame, name: str = "dog") -> DataFrame:
    """One row: the first id of the category, -1 when there is none."""
    first = categories.filter(c("name") == name).agg(F.min_by("id", "position").alias("id"))
    return first.select(F.coalesce(c("id"), F.lit(-1)).alias("category_id"))


def target_boxes(boxes: DataFrame, categories: DataFrame, name: str = "dog") -> DataFrame:
    """Boxes of the named category; none when the category is missing."""
    wanted = categories.filter(c("name") == name).agg(F.min_by("id", "position").alias("category_id"))
    return boxes.join(wanted, "category_id", "left_semi")


def split_semi(boxes: DataFrame, images: DataFrame, split: str) -> DataFrame:
    """Boxes of the images in one split."""
    return boxes.join(images.filter(c("split") == split), "image_id", "left_semi")


def negatives_anti(images: DataFrame, targets: DataFrame) -> DataFrame:
    """Images without any target box."""
    return images.join(targets, "image_id", "left_anti")


def sample_negatives(images: DataFrame, targets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return sample_n(negatives_anti(images, targets), n, "image_id", seed)


def images_with_valid_boxes(images: DataFrame, clean_boxes: DataFrame) -> DataFrame:
    """Images that keep at least one box after cleaning."""
    return images.join(clean_boxes, "image_id", "left_semi")


def filter_multi_subject(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce(c("is_multiple_dogs"), F.lit(False)))


def filter_missing_images(entries: DataFrame, files: DataFrame, path: str = "file_name") -> DataFrame:
    """Entries whose file is in the listing."""
    return entries.join(files, path, "left_semi")


def filter_placeholder_names(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.filter(~c(name).contains("%s"))


def filter_unlabelled(df: DataFrame, identity: str = "identity_label", truthy_labels: bool = False) -> DataFrame:
    """Rows with an identity. ``truthy_labels`` also drops 0 and the empty string."""
    kept = df.filter(c(identity).isNotNull())
    return kept.filter(~c(identity).cast("string").isin("", "0")) if truthy_labels else kept


def filter_nonempty_labels(images: DataFrame, lines: DataFrame, path: str = "label_path") -> DataFrame:
    """Images whose label file exists and has any line."""
    return images.join(lines.filter(c("box").isNotNull()), path, "left_semi")


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of all sources; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedupe_images(images: DataFrame, path: str = "file_name", position: str = "image_id") -> DataFrame:
    """First image of each path. An aggregate, so many copies combine before the shuffle."""
    row = F.struct(*[k for k in images.columns if k != path])
    kept = images.groupBy(path).agg(F.min_by(row, c(position)).alias("_row"))
    return kept.select(path, "_row.*").select(*images.columns)


def dedupe_pairs(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Each unordered pair once."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def annotations_per_image(boxes: DataFrame, key: str = "image_id", item: str = "ann_key", size: int = LIST_ROWS) -> DataFrame:
    """``image_id, part, n_boxes, boxes``: the boxes of an image in order of ``item``, ``size`` to a list.

    Places along (image, item) come from a range sort, which cuts an image with
    very many boxes too; ``part`` counts an image's lists from 0.
    """
    place, first = unused(boxes, "place", "first")
    placed = positions(boxes, [key, item], place)
    starts = placed.groupBy(key).agg(F.min(place).alias(first))
    part = F.floor((c(place) - c(first)) / size).cast("long")
    row = F.struct(item, *[k for k in boxes.columns if k not in {key, item}])
    listed = placed.join(starts, key).groupBy(key, part.alias("part")).agg(F.collect_list(row).alias("boxes"))
    return listed.select(key, "part", F.size("boxes").cast("long").alias("n_boxes"), F.array_sort("boxes").alias("boxes"))
