"""Dataset and run statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelage.functions.text import source_bucket
from pelage.session import materialize

c = F.col

# Epochs of one run that are ordered within one task.
HISTORY_CHUNK = 4096


def identity_sizes(images: DataFrame, identity: str = "identity") -> DataFrame:
    return images.filter(c(identity).isNotNull()).groupBy(identity).agg(F.count("*").alias("n_images"))


def identity_size_histogram(images: DataFrame, identity: str = "identity") -> DataFrame:
    """``n_images, n_identities``: identities per size."""
    return identity_sizes(images, identity).groupBy("n_images").agg(F.count("*").alias("n_identities"))


def identity_size_summary(images: DataFrame, identity: str = "identity") -> DataFrame:
    """Identities, min, max, mean and median images per identity, in one row."""
    sizes = identity_size_histogram(images, identity)
    n = c("n_identities")
    return sizes.agg(
        F.sum(n).alias("n_identities"),
        F.min("n_images").alias("min_images"),
        F.max("n_images").alias("max_images"),
        (F.sum(c("n_images") * n) / F.sum(n)).alias("mean_images"),
        F.percentile(c("n_images"), F.lit(0.5), n).alias("median_images"),
    )


def source_distribution(images: DataFrame, path: str, sources: list[tuple[str, str]]) -> DataFrame:
    """``source, n, percent``, most frequent first."""
    counts = images.groupBy(source_bucket(c(path), sources).alias("source")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a handful of rows
    return counts.withColumn("percent", c("n") * 100.0 / total).orderBy(c("n").desc(), "source")


def dataset_statistics(images: DataFrame, boxes: DataFrame, categories: DataFrame, keypoints: str | None = None) -> DataFrame:
    """One row: images, annotations, categories, and whether keypoints occur."""
    has = F.lit(False) if keypoints is None else F.coalesce(F.bool_or(c(keypoints).isNotNull()), F.lit(False))
    return boxes.agg(F.count("*").alias("num_annotations"), has.alias("has_keypoints")).select(
        images.agg(F.count("*")).scalar().alias("num_images"), "num_annotations",
        categories.agg(F.count("*")).scalar().alias("num_categories"), "has_keypoints")


def annotated_image_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: images, those with annotations, those without."""
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("_n"))
    return images.join(counts, "image_id", "left").agg(
        F.count("*").alias("n_images"),
        F.count_if(c("_n") > 0).alias("n_with_annotations"),
        F.count_if(c("_n").isNull()).alias("n_empty_labels"),
    )


def num_classes(items: DataFrame, label: str = "label") -> DataFrame:
    """max(label) + 1, whether or not every label below occurs."""
    return items.agg((F.max(label) + 1).cast("long").alias("num_classes"))


def distinct_identities(items: DataFrame, label: str = "label") -> DataFrame:
    return items.agg(F.countDistinct(label).alias("n_identities"))


def split_report(images: DataFrame, identity: str = "identity", split: str = "split") -> DataFrame:
    """``split, n_images, n_identities``."""
    per_identity = images.groupBy(split, identity).agg(F.count("*").alias("_n"))
    return per_identity.groupBy(split).agg(
        F.sum("_n").alias("n_images"), F.count(identity).alias("n_identities"))


def latest_run(runs: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """The run ``prefix<number>`` with the largest number; no number counts as 0."""
    pattern = f"^{re.escape(prefix)}([0-9]*)$"
    numbered = runs.filter(c(name).rlike(pattern)).withColumn(
        "_suffix", F.regexp_extract(name, pattern, 1))
    number = F.coalesce(F.when(c("_suffix") != "", c("_suffix")).cast("long"), F.lit(0))
    return numbered.agg(F.max_by(name, number).alias("run_name"), F.max(number).alias("run_number")).filter(
        c("run_name").isNotNull())


def latest_timestamped_run(runs: DataFrame, name: str = "name", modified: str = "modified") -> DataFrame:
    """The most recently changed run."""
    return runs.agg(F.max_by(name, F.struct(modified, name)).alias("run_name")).filter(c("run_name").isNotNull())


def training_history(history: DataFrame, patience: int = 10) -> DataFrame:
    """Adds to ``run_id, epoch, phase, map_score`` what the training loop tracks.

    ``best_so_far`` and ``is_best`` over the whole run (an epoch counts when it
    is strictly better than all before; the first is measured against -1),
    ``phase_best`` per phase, ``patience_used`` (epochs of the phase since its
    last improvement), ``early_stop`` (the first epoch of the phase to reach
    ``patience``). A missing score counts as 0.
    """
    run, phase = ["run_id", "_chunk"], ["run_id", "phase", "_chunk"]
    score, start = c("map_score"), F.lit(-1.0)
    log = history.withColumn("map_score", F.coalesce(score, F.lit(0.0))).withColumn(
        "_chunk", F.floor(c("epoch") / HISTORY_CHUNK))

    def earlier(keys: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)

    # Within a chunk of a run, and of a phase.
    rows = log.withColumns({
        "_run_in": F.max(score).over(earlier(run)),
        "_phase_in": F.max(score).over(earlier(phase)),
        "_pos_in": F.row_number().over(Window.partitionBy(*phase).orderBy("epoch")).cast("long"),
    })

    # One row per chunk: what the chunks before it hand over.
    def chunks_before(*keys: str) -> Window:
        return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    run_before = log.groupBy(*run).agg(F.max(score).alias("_top")).select(
        *run, F.max("_top").over(chunks_before("run_id")).alias("_run_before"))
    first_best = F.max(F.struct(score.alias("score"), (-c("_pos_in")).alias("neg_pos")))
    summary = rows.groupBy(*phase).agg(F.count("*").alias("_n"), first_best.alias("_top"))
    w = chunks_before("run_id", "phase")
    summary = summary.withColumn("_n_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    shifted = F.struct(c("_top.score").alias("score"), (c("_top.neg_pos") - c("_n_before")).alias("neg_pos"))
    phase_before = summary.withColumn("_top", shifted).select(
        *phase, "_n_before", F.max("_top").over(w).alias("_phase_before"))

    df = _join_null_safe(_join_null_safe(rows, run_before, run), phase_before, phase)
    df = df.withColumns({
        "_best": F.greatest(start, "_run_before", "_run_in"),
        "_phase_best": F.greatest(start, c("_phase_before.score"), c("_phase_in")),
        "_pos": c("_n_before") + c("_pos_in"),
    })
    improved = F.when(score > c("_phase_best"), c("_pos"))
    so_far = Window.partitionBy(*phase).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    # An improvement of an earlier chunk is the first place of the best score so far; scores
    # at or below -1 never improve, the wait then runs from the start of the phase.
    handed = F.when(c("_phase_before.score") > start, -c("_phase_before.neg_pos"))
    last = F.coalesce(F.greatest(F.max(improved).over(so_far), handed), F.lit(0))
    tracked = df.select(
        *history.columns,
        (score > c("_best")).alias("is_best"), F.greatest("_best", score).alias("best_so_far"),
        F.greatest("_phase_best", score).alias("phase_best"), (c("_pos") - last).alias("patience_used"))
    tracked = materialize(tracked, "training-history")
    stops = tracked.filter(c("patience_used") >= patience).groupBy("run_id", "phase").agg(
        F.min("epoch").alias("_stop"))
    stopped = _join_null_safe(tracked, stops, ["run_id", "phase"], "left")
    return stopped.withColumn("early_stop", F.coalesce(c("epoch") == c("_stop"), F.lit(False))).drop("_stop")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[c(k).alias(f"_r_{k}") if k in keys else c(k) for k in right.columns])
    condition = [c(k).eqNullSafe(c(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def best_checkpoint(history: DataFrame, patience: int = 10) -> DataFrame:
    """``run_id, best_epoch, best_map``: the epoch of each run's kept checkpoint."""
    best = training_history(history, patience).filter("is_best")
    return best.groupBy("run_id").agg(
        F.max_by("epoch", "map_score").alias("best_epoch"), F.max("map_score").alias("best_map"))
