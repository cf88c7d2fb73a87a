"""Exact order statistics of values that exist only inside tiles."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bins of one histogram pass; also the most rows one interval sends to the driver.
BINS = 1 << 16

Interval = tuple[int, int, int]  # first code, end (exclusive), bin width
HISTOGRAM_SCHEMA = "slot int, bin long, n long"


def bin_counts(codes: np.ndarray, intervals: list[Interval]) -> dict[str, np.ndarray]:
    """Tile side: counts of the codes of each interval per bin."""
    slots, bins, counts = [], [], []
    for slot, (low, high, width) in enumerate(intervals):
        inside = (codes[(codes >= low) & (codes < high)] - low) // width
        if -(-(high - low) // width) <= BINS:
            counted = np.bincount(inside)
            found = np.flatnonzero(counted)
            n = counted[found]
        else:
            found, n = np.unique(inside, return_counts=True)
        slots.append(np.full(len(found), slot))
        bins.append(found)
        counts.append(n)
    return {"slot": np.concatenate(slots), "bin": np.concatenate(bins), "n": np.concatenate(counts)}


def table_bins(df: DataFrame, column: str) -> Callable[[list[Interval]], DataFrame]:
    """The same counts over a column of a table; the intervals of one pass do not overlap."""
    value = F.col(column)

    def tiles(intervals: list[Interval]) -> DataFrame:
        spot = F.coalesce(*[
            F.when((value >= low) & (value < high), F.struct(
                F.lit(slot).alias("slot"), F.expr(f"(`{column}` - {low}L) div {width}L").alias("bin")))
            for slot, (low, high, width) in enumerate(intervals)])
        return df.select(spot.alias("spot")).filter("spot is not null").groupBy("spot.slot", "spot.bin").agg(
            F.count("*").alias("n"))

    return tiles


def order_statistics(
    tiles: Callable[[list[Interval]], DataFrame], low: int, high: int,
    ranks_of: Callable[[int], list[int]],
) -> tuple[int, dict[int, int]]:
    """Total count, and the code at each 0-based rank (ascending).

    ``tiles(intervals)`` gives ``slot, bin, n`` rows. The first pass covers
    the whole range; each further pass refines only the bins that hold a wanted
    rank, until a bin is a single code. The driver sees histograms of bounded
    size, never values.
    """
    def counted(intervals: list[Interval]) -> list[dict[int, int]]:
        rows = tiles(intervals).groupBy("slot", "bin").agg(F.sum("n").alias("n")).collect()
        result: list[dict[int, int]] = [{} for _ in intervals]
        for row in rows:
            result[row["slot"]][row["bin"]] = row["n"]
        return result

    start: Interval = (low, high, -(-(high - low) // BINS))
    histograms = counted([start])
    total = sum(histograms[0].values())
    open_ranks = {rank: (start, rank, histograms[0]) for rank in ranks_of(total)} if total else {}
    found: dict[int, int] = {}
    while open_ranks:
        finer: dict[Interval, list[tuple[int, int]]] = {}
        for rank, ((first, _end, width), local, histogram) in open_ranks.items():
            bins = sorted(histogram)
            cumulative = list(accumulate(histogram[b] for b in bins))
            at = bisect_right(cumulative, local)
            code = first + bins[at] * width
            if width == 1:
                found[rank] = code
                continue
            few = histogram[bins[at]] <= BINS
            step = 1 if few else -(-width // BINS)
            before = cumulative[at - 1] if at else 0
            finer.setdefault((code, code + width, step), []).append((rank, local - before))
        intervals = list(finer)
        open_ranks = {}
        if intervals:
            for interval, histogram in zip(intervals, counted(intervals)):
                for rank, local in finer[interval]:
                    open_ranks[rank] = (interval, local, histogram)
    return total, found


def quantile_ranks(total: int, quantiles: list[float]) -> dict[float, tuple[int, int, float]]:
    """Neighbouring ranks and weight of the linearly interpolated quantiles."""
    places = {}
    for q in quantiles:
        position = q * (total - 1)
        below = int(position)
        places[q] = (below, min(below + 1, total - 1), position - below)
    return places
