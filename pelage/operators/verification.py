"""Same-or-different verification: pairs, sampled negatives, TAR at FAR.

Items carry ``id``, ``label``, ``embedding``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.operators.negatives import Negatives, impostor_bins
from pelage.operators.retrieval import mean_average_precision
from pelage.operators.selection import order_statistics, quantile_ranks
from pelage.operators.tiles import SCALE, Block, block_count, group_tiles, keep_upper, similarity_codes
from pelage.session import materialize

c = F.col

REPORT_FARS = (0.001, 0.01, 0.1)


def positive_pairs(items: DataFrame) -> DataFrame:
    """All unordered same-identity pairs, one summary row per identity that has any.

    ``label, n_pairs, mean_similarity, min_similarity, max_similarity``.
    """
    items = items.select("id", "label", "embedding")
    label_type = items.schema["label"].dataType.simpleString()

    def summary(left: Block, right: Block, diagonal: bool) -> dict:
        sims = (left.unit @ right.unit.T)[keep_upper(None, left, right, diagonal)]
        if not len(sims):
            return {"label": [], "n": [], "total": [], "low": [], "high": []}
        return {"label": [left.labels[0]], "n": [len(sims)], "total": [sims.sum()],
                "low": [sims.min()], "high": [sims.max()]}

    schema = f"label {label_type}, n long, total double, low double, high double"
    return group_tiles(items, summary, schema, rows=items.count()).groupBy("label").agg(
        F.sum("n").alias("n_pairs"),
        (F.sum("total") / F.sum("n")).alias("mean_similarity"),
        F.min("low").alias("min_similarity"),
        F.max("high").alias("max_similarity"),
    )


def count_positive_pairs(items: DataFrame) -> int:
    sizes = items.filter(c("label").isNotNull()).groupBy("label").count()
    row = sizes.agg(F.sum((c("count") * (c("count") - 1) / 2).cast("decimal(38,0)"))).first()
    return int(row[0] or 0)


def negative_pairs(items: DataFrame, target: int, seed: int = 42, weighting: str = "identity") -> DataFrame:
    """``target`` sampled different-identity pairs, ``id_a < id_b``; all when there are fewer."""
    return Negatives(items.select("id", "label"), target, seed, weighting).ids()


# ---- TAR at FAR -------------------------------------------------------------

def _impostors(items: DataFrame, blocks: int):
    """Histograms of the similarities of all different-identity pairs."""
    return lambda intervals: impostor_bins(items, blocks, intervals)


def _thresholds(tiles, fars) -> tuple[int, dict[float, float]]:
    """Impostor count and the interpolated (1 - FAR) thresholds, in code units."""
    quantiles = {far: 1 - far for far in fars}

    def ranks(total: int) -> list[int]:
        places = quantile_ranks(total, list(quantiles.values()))
        return sorted({r for below, above, _ in places.values() for r in (below, above)})

    total, codes = order_statistics(tiles, -SCALE - 10, SCALE + 11, ranks)
    if not total:
        return 0, {}
    places = quantile_ranks(total, list(quantiles.values()))
    cuts = {}
    for far, q in quantiles.items():
        below, above, weight = places[q]
        cuts[far] = codes[below] + (codes[above] - codes[below]) * weight
    return total, cuts


def _accepted(items: DataFrame, rows: int, cuts: dict[float, float]) -> tuple[int, dict[float, int]]:
    """Genuine pairs, and those at or above each threshold."""
    levels = list(cuts.values())

    def hits(left: Block, right: Block, diagonal: bool) -> dict:
        codes = similarity_codes(left, right)[keep_upper(None, left, right, diagonal)]
        return {"n": [len(codes)], "hits": [[int((codes >= level).sum()) for level in levels]]}

    tiles = group_tiles(items, hits, "n long, hits array<long>", rows=rows)
    sums = [F.sum(c("hits")[i]).alias(f"h{i}") for i in range(len(levels))]
    row = tiles.agg(F.sum("n").alias("n"), *sums).first()
    return row["n"] or 0, {far: row[f"h{i}"] or 0 for i, far in enumerate(cuts)}


_TAR_SCHEMA = "far double, tar double, threshold double, n_genuine long, n_impostor long"


def _verifiable(items: DataFrame) -> DataFrame:
    """Items that can be in a pair, written: the passes below read them again, and models may stand behind them."""
    known = c("id").isNotNull() & c("label").isNotNull() & c("embedding").isNotNull()
    return materialize(items.select("id", "label", "embedding").filter(known), "verified-items")


def tar_at_far(items: DataFrame, fars: tuple[float, ...] = REPORT_FARS) -> DataFrame:
    """True accept rate at given false accept rates over all distinct pairs.

    The threshold is the linearly interpolated (1 - FAR) quantile of the
    impostor similarities. No rows when there are no genuine or no impostor
    pairs.
    """
    spark = items.sparkSession
    items = _verifiable(items)
    rows = items.count()
    n_impostor, cuts = _thresholds(_impostors(items, block_count(rows)), fars)
    n_genuine, hits = _accepted(items, rows, cuts) if cuts else (0, {})
    found = [(far, hits[far] / n_genuine, cuts[far] / SCALE, n_genuine, n_impostor)
             for far in cuts if n_genuine]
    return spark.createDataFrame(found, _TAR_SCHEMA)


def tar_at_far_sampled(
    items: DataFrame, fars: tuple[float, ...] = (0.01,), seed: int = 42, weighting: str = "identity",
) -> DataFrame:
    """Same from all genuine pairs and twice as many sampled impostor pairs.

    TAR and threshold are 0 when either kind of pair is missing.
    """
    return _sampled(_verifiable(items), fars, seed, weighting)


def _sampled(items: DataFrame, fars, seed: int, weighting: str) -> DataFrame:
    spark = items.sparkSession
    target = 2 * count_positive_pairs(items)
    n_impostor, cuts, rows = 0, {}, 0
    if target:
        sample = Negatives(items, target, seed, weighting)
        rows = sample.rows
        n_impostor, cuts = _thresholds(sample.histograms(), fars)
    n_genuine, hits = _accepted(items, rows, cuts) if cuts else (target // 2, {})
    found = [
        (far, hits[far] / n_genuine, cuts[far] / SCALE, n_genuine, n_impostor) if far in cuts
        else (far, 0.0, 0.0, n_genuine, n_impostor)
        for far in fars
    ]
    return spark.createDataFrame(found, _TAR_SCHEMA)


def embedding_report(items: DataFrame, seed: int = 42, weighting: str = "identity") -> DataFrame:
    """One row: mAP, TAR and threshold at 1 % and 0.1 % FAR, number of identities.

    No row for an empty table.
    """
    items = _verifiable(items)
    tar = _sampled(items, (0.01, 0.001), seed, weighting)
    at = tar.agg(*[
        F.max(F.when(c("far") == far, c(column))).alias(name)
        for far, column, name in (
            (0.01, "tar", "tar_far_1pct"), (0.001, "tar", "tar_far_0_1pct"),
            (0.01, "threshold", "threshold_1pct"), (0.001, "threshold", "threshold_0_1pct"),
        )
    ])
    quality = mean_average_precision(items).select("map").scalar()
    identities = items.agg(F.countDistinct("label")).scalar()
    report = at.select(quality.alias("map"), *at.columns, identities.alias("num_identities"))
    return report.filter(c("num_identities") > 0)
