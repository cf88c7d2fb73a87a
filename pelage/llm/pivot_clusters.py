"""Integer k-means with a pivot table (linear approximating and eliminating search).

Vectors become integers. The distance of every vector to a few fixed pivots is
computed once and stored beside it. In a round the centroids are measured
against the same pivots; by the triangle inequality the largest difference of
the two distances to a pivot is at least never above the distance between
vector and centroid. The centroid with the least bound is measured first, then
each other one only for the vectors whose bound does not exceed the best
distance so far. Distances are exact integers, the bounds give way by more than
their rounding, and of equally near centroids the one with the smaller number
wins, so the clusters are those of an exhaustive search.

Pivots are the starting centroids and, where more are asked for, the vectors
next to them in hash order, so the first round knows its distances from the
table alone.

Cases: vectors that are NULL, of another length, or hold NULL or non-finite
components are left out; a component so large that squared distances would not
fit a long is refused with an error; rows with a NULL id are clustered but
never start a centroid; repeated rows count each; an empty
table gives an empty result, fewer rows than centroids as many clusters as
rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.storage import stored

c = F.col

# Vectors that a task measures at once.
ROWS = 4096


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, q``: the vectors that are kept, as ``floor(scale * x)`` in double precision."""
    x = c("vector")
    size = F.size(x)
    # Squared distances then stay below 2**62.
    largest = math.isqrt((1 << 60) // dims)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select(c(id_col).cast("long").alias("id"), c(vector_col).cast("array<double>").alias("vector")).where(
        x.isNotNull() & (size == dims) & finite).select(
        "id", F.transform(x, lambda v: F.when(F.abs(v * scale) <= largest, F.floor(v * scale)).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {largest}")).cast("long"))).alias("q"))


def starts(kept: DataFrame, seed: int, count: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hash of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), c("id").cast("string")), 256)
    rows = kept.where(c("id").isNotNull()).select("q", order.alias("hash")).orderBy("hash", "q").limit(count).collect()
    return np.array([row["q"] for row in rows], np.int64)


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def _measure(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    m, dims = pivots.shape
    for batch in batches:
        points = _matrix(batch.column("q"), dims)
        table = np.sqrt(np.stack([_squared(points, p) for p in pivots], axis=1).astype(float))
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "q": batch.column("q"),
            "pivots": pa.ListArray.from_arrays(np.arange(0, len(points) * m + 1, m, dtype=np.int32), table.ravel())})


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, q, pivots``: written once with the distance of every vector to each pivot."""
    return stored(kept.mapInArrow(lambda b: _measure(b, pivots), "id long, q array<long>, pivots array<double>"), "pivot-table")


class Nearest:
    """Nearest of the centroids by elimination against the pivot table."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        self.between = np.sqrt(np.stack([_squared(centroids, p) for p in pivots], axis=1).astype(float))
        self.measured = 0

    def bounds(self, table: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each row to each centroid, less than the rounding of the roots below it."""
        least = np.zeros((len(table), len(self.centroids)))
        for p in range(table.shape[1]):
            np.maximum(least, np.abs(table[:, p, None] - self.between[None, :, p]), out=least)
        room = 1e-9 * (1 + table.max(1, initial=0) + self.between.max(initial=0))
        return np.maximum(least - room[:, None], 0)

    def __call__(self, points: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row."""
        least = self.bounds(table) ** 2
        rows = np.arange(len(points))
        cluster = least.argmin(1)
        gap = points - self.centroids[cluster]
        best = np.einsum("ij,ij->i", gap, gap)
        self.measured += len(points)
        least[rows, cluster] = np.inf
        for j, centre in enumerate(self.centroids):
            alive = np.flatnonzero(least[:, j] <= best)
            if not len(alive):
                continue
            distance = _squared(points[alive], centre)
            self.measured += len(alive)
            nearer = (distance < best[alive]) | ((distance == best[alive]) & (j < cluster[alive]))
            at = alive[nearer]
            cluster[at], best[at] = j, distance[nearer]
        return cluster, best


def _assigned(batches: Iterator[pa.RecordBatch], nearest: Nearest) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    dims, m = nearest.centroids.shape[1], nearest.between.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            points = _matrix(part.column("q"), dims)
            yield part, points, *nearest(points, _matrix(part.column("pivots"), m))


def _sums(batches: Iterator[pa.RecordBatch], nearest: Nearest) -> Iterator[pa.RecordBatch]:
    """Per cluster the vectors' number and componentwise sum, once per task."""
    k, dims = nearest.centroids.shape
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for _, points, cluster, _ in _assigned(batches, nearest):
        for j in np.unique(cluster):
            mine = cluster == j
            sums[j] += points[mine].sum(0)
            counts[j] += mine.sum()
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({
        "cluster": pa.array(some.astype(np.int32)), "n": pa.array(counts[some]),
        "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})


def update(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor of sum by count in exact integers; a centroid without vectors stays.

    The driver gets one sum per centroid and component.
    """
    nearest = Nearest(pivots, centroids)
    parts = table.mapInArrow(lambda b: _sums(b, nearest), "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value"))
    result = centroids.copy()
    for row in parts.groupBy("cluster", "place").agg(
            F.sum(c("value").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        result[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return result


def _places(batches: Iterator[pa.RecordBatch], nearest: Nearest) -> Iterator[pa.RecordBatch]:
    for part, _, cluster, distance in _assigned(batches, nearest):
        yield pa.RecordBatch.from_pydict({
            "id": part.column("id"), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})


def clusters(vectors: DataFrame, id_col: str, vector_col: str, dims: int = 64, scale: int = 64, count: int = 16,
             rounds: int = 3, seed: int = 1, pivots: int = 16) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` (squared) after ``rounds`` updates, written, and the final centroids."""
    kept = integers(vectors, id_col, vector_col, dims, scale)
    first = starts(kept, seed, max(count, pivots))
    if not len(first):
        spark = vectors.sparkSession
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    fixed, centroids = first[:pivots], first[:count]
    table = pivot_table(kept, fixed)
    for _ in range(rounds):
        centroids = update(table, fixed, centroids)
    nearest = Nearest(fixed, centroids)
    return stored(table.mapInArrow(lambda b: _places(b, nearest), "id long, cluster int, distance long"), "clusters"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``clusters`` with the inertia of their cluster, of all, and the hash of their centroid."""
    spark = assigned.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(centroids.tolist())]
    total = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = total.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    # One row per cluster.
    sums = named.withColumn("inertia", total.agg(F.sum("cluster_inertia")).scalar())
    return assigned.join(F.broadcast(sums), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
