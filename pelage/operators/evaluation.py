"""Evaluation of an identification run: detection and ranking metrics, failures, reports.

A probe table has ``id``, ``identity_gt`` (NULL = no animal), ``has_pred`` and
``embedding``. Every probe with a prediction is also a gallery item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelage.functions.text import failure_caption
from pelage.operators.retrieval import identity_rank, mean_reciprocal_rank, topk_accuracy, topk_neighbors
from pelage.operators.verification import REPORT_FARS, tar_at_far
from pelage.session import materialize

c = F.col

REPORT_KS = (1, 3, 5, 10)

# Failure categories and their caption titles.
FAILURE_TITLES = {
    "missed_detections": "Missed Detection",
    "false_positives": "False Positive",
    "wrong_identities": "Wrong Identity (Rank != 1)",
}


def _labelled(truthy_labels: bool):
    known = c("identity_gt").isNotNull()
    return known & ~c("identity_gt").cast("string").isin("", "0") if truthy_labels else known


def gallery_of(probes: DataFrame, truthy_labels: bool = False) -> DataFrame:
    """Detected probes as gallery items ``id, label, embedding``."""
    label = F.when(_labelled(truthy_labels), c("identity_gt"))
    return probes.filter("has_pred").select("id", label.alias("label"), "embedding")


def evaluate(probes: DataFrame, truthy_labels: bool = False) -> DataFrame:
    """Per-probe result: both flags, whether they agree, and the identity rank.

    ``truthy_labels`` treats identity 0 and the empty string as unlabelled in
    the ranking.
    """
    ranks = identity_rank(gallery_of(probes, truthy_labels))
    has_gt = c("identity_gt").isNotNull()
    results = probes.select(
        "id", has_gt.alias("has_animal_gt"), c("has_pred").alias("has_animal_pred"), "identity_gt",
        (has_gt == c("has_pred")).alias("detection_correct"))
    return results.join(ranks, "id", "left")


def with_matches(results: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """Adds ``similar_images``: the first ``k`` matches of a probe as ``(id, similarity)`` in order, empty without any.

    ``matches`` as ``topk_neighbors`` gives them.
    """
    entry = F.struct("rank", c("gallery_id").alias("id"), "similarity")
    listed = matches.filter(c("rank") <= k).groupBy(c("probe_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("_m"))
    plain = F.transform("_m", lambda m: F.struct(m["id"].alias("id"), m["similarity"].alias("similarity")))
    none = F.array().cast(listed.select(plain.alias("m")).schema["m"].dataType)
    return results.join(listed, "id", "left").withColumn("similar_images", F.coalesce(plain, none)).drop("_m")


def detection_metrics(results: DataFrame) -> DataFrame:
    """One row of counts, accuracy, precision and recall (0 where undefined)."""
    gt, pred = c("has_animal_gt"), c("has_animal_pred")
    counts = results.agg(
        F.count("*").alias("total_images"),
        F.count_if(gt).alias("animal_images"),
        F.count_if(~gt).alias("non_animal_images"),
        F.count_if(gt == pred).alias("_right"),
        F.count_if(gt & pred).alias("true_positives"),
        F.count_if(~gt & pred).alias("false_positives"),
        F.count_if(gt & ~pred).alias("false_negatives"),
    )

    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    tp = c("true_positives")
    return counts.select(
        share(c("_right"), c("total_images")).alias("accuracy"),
        share(tp, tp + c("false_positives")).alias("precision"),
        share(tp, tp + c("false_negatives")).alias("recall"),
        "true_positives", "false_positives", "false_negatives",
        "total_images", "animal_images", "non_animal_images",
    )


def benchmark_report(probes: DataFrame, truthy_labels: bool = False) -> DataFrame:
    """The whole metric bundle in long form: ``metric, k, value``.

    ``k`` is the cut-off of a top-k accuracy or the FAR of a TAR/threshold row.
    """
    # Several passes read the probes, and models may stand behind them.
    probes = materialize(probes.select("id", "identity_gt", "has_pred", "embedding"), "benchmark-probes")
    return report_of(probes, evaluate(probes, truthy_labels), truthy_labels)


def report_of(probes: DataFrame, results: DataFrame, truthy_labels: bool = False) -> DataFrame:
    """The bundle of probes that are stored and evaluated already."""
    # Read three times below; written once so that the ranking runs once.
    results = materialize(results, "evaluation-results")
    detection = detection_metrics(results)
    none = F.lit(None).cast("double")

    def scalars(df: DataFrame, names: dict[str, str]) -> DataFrame:
        rows = F.array(*[
            F.struct(F.lit(metric).alias("metric"), none.alias("k"), c(column).cast("double").alias("value"))
            for metric, column in names.items()
        ])
        return df.select(F.inline(rows))

    detected = scalars(detection, {
        "detection_accuracy": "accuracy", "detection_precision": "precision", "detection_recall": "recall",
        "total_images": "total_images", "animal_images": "animal_images",
        "non_animal_images": "non_animal_images",
    })
    mrr = scalars(mean_reciprocal_rank(results), {"mean_reciprocal_rank": "mrr", "n_ranked": "n_ranked"})
    topk = topk_accuracy(results, REPORT_KS).select(
        F.lit("top_k_accuracy").alias("metric"), c("k").cast("double").alias("k"), c("accuracy").alias("value"))
    tar = tar_at_far(gallery_of(probes, truthy_labels), REPORT_FARS)
    tar_rows = tar.select(F.inline(F.array(
        F.struct(F.lit("tar_at_far").alias("metric"), c("far").alias("k"), c("tar").alias("value")),
        F.struct(F.lit("threshold_at_far").alias("metric"), c("far").alias("k"), c("threshold").alias("value")),
    )))
    return reduce(DataFrame.unionByName, [detected, mrr, topk, tar_rows])


def metrics_log(report: DataFrame, run: str, prefix: str = "") -> DataFrame:
    """The report as named scalars ``run, metric, value`` for an append-only log.

    Only k = 1, 3, 5 and the totals a tracker shows; a FAR of 0.001 is named ``0_001``.
    """
    decimal = F.regexp_replace(c("k").cast("decimal(18,12)").cast("string"), "0+$", "")
    far_name = F.concat(F.lit("tar_at_far_"), F.replace(decimal, F.lit("."), F.lit("_")))
    top_name = F.concat(F.lit("top_"), c("k").cast("int").cast("string"), F.lit("_accuracy"))
    plain = ["detection_accuracy", "detection_precision", "detection_recall", "mean_reciprocal_rank", "total_images"]
    name = (
        F.when(c("metric").isin(*plain), c("metric"))
        .when((c("metric") == "top_k_accuracy") & c("k").isin(1.0, 3.0, 5.0), top_name)
        .when(c("metric") == "tar_at_far", far_name)
    )
    return report.select(F.lit(run).alias("run"), name.alias("metric"), "value").filter(
        c("metric").isNotNull()).withColumn("metric", F.concat(F.lit(prefix), c("metric")))


def pair_identity_lookup(matches: DataFrame, probes: DataFrame) -> DataFrame:
    """Matches between detected, labelled probes, with whether the identities agree.

    A match whose other side is not a detected, labelled probe is dropped.
    """
    known = probes.filter(c("has_pred") & c("identity_gt").isNotNull())
    left = known.select(c("id").alias("probe_id"), c("identity_gt").alias("probe_identity"))
    right = known.select(c("id").alias("gallery_id"), c("identity_gt").alias("gallery_identity"))
    return matches.join(left, "probe_id").join(right, "gallery_id").withColumn(
        "same_identity", c("probe_identity") == c("gallery_identity"))


def prediction_identity(probes: DataFrame) -> DataFrame:
    """``id, predicted, similarity``: identity of the best match, ``?`` if it has none."""
    detected = probes.filter("has_pred").select("id", "embedding")
    top = topk_neighbors(detected, 1)
    identities = probes.select(c("id").alias("gallery_id"), c("identity_gt").cast("string").alias("_identity"))
    return top.join(identities, "gallery_id", "left").select(
        c("probe_id").alias("id"), F.coalesce(c("_identity"), F.lit("?")).alias("predicted"), "similarity")


def query_subset(probes: DataFrame, requested: DataFrame, k: int = 5) -> DataFrame:
    """Top-k matches of the requested probe ids, each with the match's identity and
    whether it is right."""
    asked = probes.join(requested, "id", "left_semi").filter("has_pred")
    gallery = probes.filter("has_pred").select("id", "embedding")
    matches = topk_neighbors(asked.select("id", "embedding"), k, gallery)
    mine = asked.select(c("id").alias("probe_id"), c("identity_gt").alias("probe_identity"))
    theirs = probes.select(c("id").alias("gallery_id"), c("identity_gt").alias("match_identity"))
    right = F.coalesce(c("probe_identity") == c("match_identity"), F.lit(False))
    return matches.join(mine, "probe_id").join(theirs, "gallery_id", "left").withColumn("is_correct", right)


def failure_tables(results: DataFrame, predictions: DataFrame | None = None, max_failures: int = 20) -> DataFrame:
    """The first ``max_failures`` probes (by id) of each kind of failure, with a caption."""
    gt, pred = c("has_animal_gt"), c("has_animal_pred")
    category = (
        F.when(gt & ~pred, "missed_detections")
        .when(~gt & pred, "false_positives")
        .when(gt & pred & ~c("identity_rank").eqNullSafe(1), "wrong_identities")
    )
    w = Window.partitionBy("category").orderBy("id")
    failed = results.withColumn("category", category).filter(c("category").isNotNull())
    first = failed.withColumn("position", F.row_number().over(w).cast("long")).filter(c("position") <= max_failures)
    if predictions is None:
        first = first.withColumn("predicted", F.lit(None).cast("string")).withColumn(
            "similarity", F.lit(None).cast("double"))
    else:
        first = first.join(predictions, "id", "left")
    title = F.create_map(*[F.lit(x) for pair in FAILURE_TITLES.items() for x in pair])[c("category")]
    caption = failure_caption(
        title, c("identity_gt").cast("string"), c("identity_rank"), c("has_animal_pred"),
        c("predicted"), c("similarity"))
    return first.select("category", "position", "id", "identity_gt", "identity_rank", caption.alias("caption"))
