"""Clustering with a pivot table, against exhaustive integer k-means."""

import hashlib
import math

import numpy as np
import pytest

from pelage.llm import pivot_clusters

SCHEMA = "vec_id long, embedding array<float>, label int, q string, id string, pivots string, cluster string, n long"


def rows_of(vectors, start=0):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x", "x", 1)
            for i, v in enumerate(vectors, start)]


def exhaustive(rows, dims, scale=64, count=16, rounds=3, seed=1):
    """[(id, cluster, distance)], centroids, by plain integers."""
    kept = []
    for r in rows:
        v = r[1]
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((r[0], [math.floor(scale * float(np.float32(x))) for x in v]))
    order = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None))
    centroids = [q for _, q in order[:count]]

    def assign():
        out = []
        for i, q in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(q, z)) for z in centroids]
            best = min(distances)
            out.append((i, distances.index(best), best))
        return out

    for _ in range(rounds):
        places = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (_, k, _) in zip(kept, places) if k == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return assign(), centroids


def run(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return pivot_clusters.clusters(vectors, "vec_id", "embedding", **options)


def mixed(n, dims=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims)) * 2
    return [(centres[i % 5] + r.normal(size=dims) * (0.02 if i % 3 else 1)).tolist() for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 4, 9])
def test_equals_exhaustive_search(spark, pivots):
    vectors = mixed(300)
    vectors += vectors[:40] + [[0.0] * 8] * 20  # copies and ties
    rows = rows_of(vectors)
    assigned, centroids = run(spark, rows, dims=8, count=6, pivots=pivots)
    want, want_centroids = exhaustive(rows, 8, count=6)
    assert sorted(map(tuple, assigned.collect())) == sorted(want)
    assert centroids.tolist() == want_centroids


def test_edge_cases(spark):
    good = mixed(30)
    rows = rows_of(good)
    rows += rows_of([None, [], [1.0] * 7, [1.0] * 9, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7], 100)
    rows += [(None, good[0], None, None, None, None, None, None), rows[3], rows[3]]
    assigned, centroids = run(spark, rows, dims=8, count=4, pivots=4)
    want, _ = exhaustive(rows, 8, count=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(want, key=key)
    table = pivot_clusters.report(assigned, centroids).toPandas()
    assert len(table) == len(want) and table.inertia.nunique() == 1 and table.inertia[0] == sum(d for _, _, d in want)
    for cluster, part in table.groupby("cluster"):
        assert (part.cluster_inertia == part.distance.sum()).all()
        text = ",".join(map(str, centroids[cluster].tolist()))
        assert set(part.centroid_sha256) == {hashlib.sha256(text.encode()).hexdigest()}


def test_fewer_rows_than_centroids_and_none(spark):
    rows = rows_of(mixed(3))
    assigned, centroids = run(spark, rows, dims=8)
    assert len(centroids) == 3 and sorted(r.distance for r in assigned.collect()) == [0, 0, 0]
    for nothing in ([], rows_of([None, [1.0]])):
        assigned, centroids = run(spark, nothing, dims=8)
        assert pivot_clusters.report(assigned, centroids).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, rows_of([[1e30] * 8]), dims=8)


def test_ties_go_to_the_smaller_number(spark):
    rows = rows_of([[x / 64] for x in (0, 2, 1, 1, 1)])
    first = pivot_clusters.starts(pivot_clusters.integers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 1, 64), 1, 5)
    assigned, _ = run(spark, rows, dims=1, count=5, rounds=0)
    numbers = first.ravel().tolist()
    for r in assigned.collect():
        value = int(rows[r.id][1][0] * 64)
        assert r.cluster == numbers.index(value) and r.distance == 0


def test_bounds_hold_and_leave_centroids_out():
    """No bound exceeds the true distance, and on clustered vectors most distances are never computed."""
    points = np.floor(np.array(mixed(2000)) * 64).astype(np.int64)
    pivots, centroids = points[:16], points[16:32]
    table = np.sqrt(np.stack([((points - p) ** 2).sum(1) for p in pivots], 1).astype(float))
    nearest = pivot_clusters.Nearest(pivots, centroids)
    true = np.sqrt(((points[:, None] - centroids[None]) ** 2).sum(2))
    assert (nearest.bounds(table) <= true).all()
    cluster, distance = nearest(points, table)
    assert (distance == ((points[:, None] - centroids[None]) ** 2).sum(2).min(1)).all()
    assert (cluster == (true ** 2).round().argmin(1)).all()
    assert nearest.measured < 0.5 * true.size


def test_large_values_keep_exact(spark):
    vectors = [[x * 1000.0 for x in v] for v in mixed(60)]
    rows = rows_of(vectors)
    assigned, _ = run(spark, rows, dims=8, count=5, pivots=5)
    assert sorted(map(tuple, assigned.collect())) == sorted(exhaustive(rows, 8, count=5)[0])
