"""Tile-based metrics against brute force, with small blocks and one label that holds a third."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelage.operators import evaluation as E
from pelage.operators import heads as H
from pelage.operators import negatives as N
from pelage.operators import prefix as P
from pelage.operators import pruned
from pelage.operators import retrieval as R
from pelage.operators import tiles
from pelage.operators import verification as V
from pelage.operators.pruned import topk_neighbors_pruned

SCHEMA = "id long, label int, embedding array<float>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 24)
    monkeypatch.setattr(tiles, "MIN_BLOCK_ROWS", 8)


def make(seed=0, n=180, dim=6, copies=40, labels=8, spread=0.6):
    """Clustered vectors; label 0 holds a third of the rows, ``copies`` rows are equal,
    one vector is zero."""
    rng = np.random.default_rng(seed)
    label = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, labels, n))
    centers = rng.normal(size=(labels, dim))
    vectors = (centers[label] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    vectors[5:5 + copies] = vectors[5]
    vectors[3] = 0
    ids = rng.permutation(n * 7)[:n]
    return ids, label, vectors


def frame(spark, ids, label, vectors):
    rows = [(int(i), None if y is None else int(y), [float(x) for x in v]) for i, y, v in zip(ids, label, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def cosines(vectors):
    v = vectors.astype(np.float64)
    norms = np.linalg.norm(v, axis=1)
    unit = v / np.where(norms > 0, norms, 1)[:, None]
    return np.rint(unit @ unit.T * 1e9) / 1e9


def ranking(ids, sims, q):
    order = sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-sims[q, j], ids[j]))
    return order


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture
def items(spark, data, small_blocks):
    return frame(spark, *data)


def test_topk(data, items):
    ids, _, vectors = data
    sims = cosines(vectors)
    want = {(int(ids[q]), r + 1, int(ids[j])) for q in range(len(ids)) for r, j in enumerate(ranking(ids, sims, q)[:4])}
    got = {(r.probe_id, r.rank, r.gallery_id) for r in R.topk_neighbors(items, 4).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_pruned_search_is_exact(spark, small_blocks, spread):
    ids, label, vectors = make(seed=4, n=260, copies=60, spread=spread)
    vectors[7:20] = 0
    items = frame(spark, ids, label, vectors)
    sims = cosines(vectors)
    want = {(int(ids[q]), r + 1, int(ids[j])) for q in range(len(ids)) for r, j in enumerate(ranking(ids, sims, q)[:4])}
    assert {(r.probe_id, r.rank, r.gallery_id) for r in topk_neighbors_pruned(items, 4).collect()} == want
    probes = items.filter("id % 3 = 0").select((-items.id - 1).alias("id"), "embedding")
    got = topk_neighbors_pruned(probes, 3, items).collect()
    plain = R.topk_neighbors(probes, 3, items.select("id", "embedding")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in plain}


def test_topk_of_a_tiny_gallery(spark):
    gallery = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id long, embedding array<double>")
    probe = spark.createDataFrame([(9, [1.0, 0.0])], "id long, embedding array<double>")
    rows = R.topk_neighbors(probe, 5, gallery).orderBy("rank").collect()
    assert [(r.gallery_id, round(r.similarity, 3)) for r in rows] == [(1, 1.0), (2, 0.994)]


def test_rank_gallery_without_gallery_or_embedding(spark):
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<double>")
    empty = probes.filter("id > 5")
    rows = {r.probe_id: (r.has_animal, r.gallery_id) for r in R.rank_gallery(probes, empty, 3).collect()}
    assert rows == {1: (True, None), 2: (False, None)}


def test_identity_rank(data, items):
    ids, label, vectors = data
    sims = cosines(vectors)
    want = {}
    for q in range(len(ids)):
        places = [r for r, j in enumerate(ranking(ids, sims, q), 1) if label[j] == label[q]]
        if places:
            want[int(ids[q])] = places[0]
    got = {r.id: r.identity_rank for r in R.identity_rank(items).collect()}
    assert got == want


def test_identity_rank_ignores_unlabelled_as_partner(spark, small_blocks):
    rows = [(1, 0, [1.0, 0.0]), (2, None, [1.0, 0.01]), (3, 0, [0.7, 0.7]), (4, None, [0.0, 1.0])]
    got = {r.id: r.identity_rank for r in R.identity_rank(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 2, 3: 2}


@pytest.mark.parametrize("exclude_self", [False, True])
def test_mean_average_precision(data, items, exclude_self):
    ids, label, vectors = data
    sims = cosines(vectors)
    aps = []
    for q in range(len(ids)):
        keep = np.arange(len(ids)) != q if exclude_self else np.ones(len(ids), bool)
        relevant = (label == label[q]) & (np.arange(len(ids)) != q)
        if not relevant.any():
            continue
        levels = sims[q][relevant]
        hits = np.array([(sims[q][relevant] >= s).sum() for s in levels])
        seen = np.array([(sims[q][keep] >= s).sum() for s in levels])
        aps.append((hits / seen).mean())
    row = R.mean_average_precision(items, exclude_self).first()
    assert row.n_queries == len(aps)
    assert row.map == pytest.approx(np.mean(aps), abs=1e-9)


def pair_scores(ids, label, vectors):
    sims = cosines(vectors)
    a, b = np.triu_indices(len(ids), 1)
    same = label[a] == label[b]
    return sims[a, b][same], sims[a, b][~same]


def test_tar_at_far(data, items):
    genuine, impostor = pair_scores(*data)
    for row in V.tar_at_far(items).collect():
        threshold = np.quantile(impostor, 1 - row.far)
        assert row.threshold == pytest.approx(threshold, abs=1e-9)
        assert row.tar == pytest.approx((genuine >= threshold - 1e-12).mean())
        assert (row.n_genuine, row.n_impostor) == (len(genuine), len(impostor))


def test_positive_pair_summary(data, items):
    ids, label, vectors = data
    sims = cosines(vectors)
    for row in V.positive_pairs(items).collect():
        members = np.flatnonzero(label == row.label)
        a, b = np.triu_indices(len(members), 1)
        scores = sims[members[a], members[b]]
        assert row.n_pairs == len(scores)
        assert row.mean_similarity == pytest.approx(scores.mean(), abs=1e-8)
        assert row.max_similarity == pytest.approx(scores.max(), abs=1e-8)


def test_gallery_pair_summary(data, items):
    ids, _, vectors = data
    sims = cosines(vectors)
    np.fill_diagonal(sims, np.nan)
    want = dict(zip(ids.tolist(), np.nanmean(sims, axis=1)))
    for row in R.gallery_pairs(items).collect():
        assert row.n_pairs == len(ids) - 1
        assert row.mean_similarity == pytest.approx(want[row.probe_id], abs=1e-8)


def slots(labels, ids, seed, weighting, count):
    """The pairs that the first slots name, in slot order, by plain Python; ``None`` draws of equal labels left out."""
    places = sorted(range(len(ids)), key=lambda i: (labels[i], ids[i]))
    groups = {}
    for place, i in enumerate(places):
        groups.setdefault(labels[i], []).append(place)
    members = list(groups.values())

    def number(key, half, n):
        return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[15 * half:15 * half + 15], 16) % n

    named = {}
    for slot in range(count):
        if weighting == "identity":
            a = number(f"{slot}|0", 0, len(members))
            b = number(f"{slot}|0", 1, len(members) - 1)
            b += b >= a
            pair = (members[a][number(f"{slot}|1", 0, len(members[a]))], members[b][number(f"{slot}|1", 1, len(members[b]))])
        else:
            a = number(f"{slot}|0", 0, len(ids))
            b = number(f"{slot}|0", 1, len(ids) - 1)
            pair = (a, b + (b >= a))
        one, two = (places[x] for x in pair)
        if labels[one] != labels[two]:
            named.setdefault(tuple(sorted((ids[one], ids[two]))), slot)
    return named


@pytest.mark.parametrize("weighting", ["identity", "pair"])
@pytest.mark.parametrize("target", [1, 500, 3000])
def test_negative_pairs_are_those_of_the_first_slots(data, items, weighting, target):
    ids, label, _ = data
    named = slots(label.tolist(), ids.tolist(), 42, weighting, 6 * target + 64)
    want = set(sorted(named, key=named.get)[:target])
    found = V.negative_pairs(items, target, weighting=weighting).collect()
    assert len(found) == target and {(r.id_a, r.id_b) for r in found} == want


def test_negative_pairs_of_text_ids_and_missing_rows(spark):
    rows = [(f"img-{i:03d}", None if i % 11 == 0 else f"dog {i % 7}") for i in range(200)] + [(None, "dog 1")]
    found = V.negative_pairs(spark.createDataFrame(rows, "id string, label string"), 300).collect()
    known = {i: x for i, x in rows if i is not None and x is not None}
    assert len({tuple(r) for r in found}) == 300
    assert all(r.id_a < r.id_b and known[r.id_a] != known[r.id_b] for r in found)


@pytest.mark.parametrize("weighting", ["identity", "pair"])
def test_negative_pairs_all_when_fewer(spark, small_blocks, weighting):
    ids, label, vectors = make(n=12, copies=2, labels=3)
    found = V.negative_pairs(frame(spark, ids, label, vectors), 10_000, weighting=weighting).collect()
    a, b = np.triu_indices(12, 1)
    assert len(found) == (label[a] != label[b]).sum() == len({tuple(r) for r in found})
    assert V.negative_pairs(frame(spark, ids, [1] * 12, vectors), 5).count() == 0
    assert V.negative_pairs(frame(spark, ids, label, vectors), 0).count() == 0
    with pytest.raises(ValueError):
        V.negative_pairs(frame(spark, ids, label, vectors), 5, weighting="size")


def test_negative_pairs_beyond_the_slots(spark, monkeypatch):
    """Nearly all pairs of very uneven labels: what no slot names follows by keys, each pair once, the first draws kept."""
    labels = [0] * 60 + [1] * 2 + [2] * 2 + [3]
    different = (65 ** 2 - 3600 - 4 - 4 - 1) // 2
    items = spark.createDataFrame(list(enumerate(labels)), "id long, label long")
    monkeypatch.setattr(N, "LAST", 1)
    target = different - 3
    found = {tuple(r) for r in V.negative_pairs(items, target).collect()}
    assert len(found) == target and all(labels[a] != labels[b] for a, b in found)
    assert set(slots(labels, list(range(65)), 42, "identity", different)) <= found


def test_negative_pairs_with_one_huge_label(spark, monkeypatch):
    """A label with most rows and one with a single item: its copies take its many pairs, no pair is lost."""
    monkeypatch.setattr(N, "PAIRS_PER_COPY", 50)
    labels = [0] * 3000 + [1] + [2] * 40
    items = spark.createDataFrame(list(enumerate(labels)), "id long, label long").repartition(4)
    sample = N.Negatives(items, 3000, 7)
    assert sample.labels.select(F.max(sample._copies(F.col("n")))).first()[0] > 20
    found = {tuple(r) for r in sample.ids().collect()}
    named = slots(labels, list(range(3041)), 7, "identity", 12000)
    assert found == set(sorted(named, key=named.get)[:3000])


def test_sampled_tar_equals_plain_numbers(data, items):
    ids, label, vectors = data
    at = {int(x): i for i, x in enumerate(ids)}
    sims = np.round(cosines(vectors), 9)
    a, b = np.triu_indices(len(ids), 1)
    genuine = sims[a, b][label[a] == label[b]]
    named = slots(label.tolist(), ids.tolist(), 42, "identity", 8 * len(genuine) + 64)
    pairs = sorted(named, key=named.get)[:2 * len(genuine)]
    impostors = np.array([sims[at[x], at[y]] for x, y in pairs])
    row = V.tar_at_far_sampled(items).first()
    threshold = np.quantile(impostors, 0.99)
    assert (row.n_genuine, row.n_impostor) == (len(genuine), len(pairs))
    assert row.threshold == pytest.approx(threshold, abs=2e-9) and row.tar == pytest.approx((genuine >= threshold).mean(), abs=1e-9)


@pytest.mark.parametrize("levels, stripe", [(50, 10**6), (400, 60), (7, 30)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_average_precision_in_stripes_and_chunks(data, items, monkeypatch, levels, stripe, exclude_self):
    """Few levels per block: the large label comes in chunks; a small stripe: the counts of a probe are added up."""
    want = {r.id: r.ap for r in R.average_precision(items, exclude_self).collect()}
    monkeypatch.setattr(R, "_LEVELS_PER_BLOCK", levels)
    monkeypatch.setattr(R, "_STRIPE_ROWS", stripe)
    got = R.average_precision(items, exclude_self).collect()
    assert len(got) == len(want)
    for row in got:
        assert row.ap == pytest.approx(want[row.id], abs=1e-12)


def test_average_precision_of_repeated_ids_and_missing_rows(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 1, [1.0, 0.1]), ("c", 2, [1.0, 0.2]), ("d", None, [1.0, 0.0]),
            (None, 1, [1.0, 0.0]), ("e", 2, None)]
    items = spark.createDataFrame(rows, "id string, label long, embedding array<float>")
    assert sorted(r.id for r in R.average_precision(items).collect()) == ["a", "a", "b"]
    assert R.mean_average_precision(items.limit(0)).first() == (0.0, 0)
    assert R.mean_average_precision(items.filter("label = 2")).first() == (0.0, 0)


def test_positions_and_sums_along_a_sort(spark, monkeypatch):
    """Places and running sums over several sorted partitions and blocks of them, with clashing column names."""
    monkeypatch.setattr(P, "PARTS_PER_BLOCK", 2)
    r = np.random.default_rng(4)
    values = r.permutation(5000)
    rows = spark.createDataFrame([(int(v), int(v % 7), "x", 1) for v in values], "v long, w long, _at string, _part long").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = P.positions(rows, [F.col("v").desc()], "place").collect()
        sums = P.running(rows, [], ["v"], {"s": ("sum", F.col("w")), "n": ("sum", F.lit(1))}, inclusive=False).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert all(x.place == 4999 - x.v and x._at == "x" for x in placed) and len(placed) == 5000
    want = np.concatenate([[0], np.cumsum(np.arange(5000) % 7)])
    assert all((x.s, x.n, x._part) == (want[x.v], x.v, 1) for x in sums) and len(sums) == 5000
    assert P.positions(rows.limit(0), ["v"]).count() == 0
    assert P.running(rows.limit(0), [], ["v"], {"s": ("sum", F.lit(1))}).count() == 0


def test_sampled_tar_edge_cases(spark):
    distinct = frame(spark, range(6), range(6), np.eye(6, dtype=np.float32))
    single = frame(spark, range(6), [1] * 6, np.eye(6, dtype=np.float32))
    assert V.tar_at_far_sampled(distinct).first().tar == 0.0
    row = V.tar_at_far_sampled(single).first()
    assert (row.tar, row.threshold) == (0.0, 0.0)
    assert V.tar_at_far(distinct).count() == 0
    assert V.tar_at_far(single).count() == 0
    assert V.embedding_report(single.limit(0)).count() == 0


def test_separated_clusters_verify(spark, small_blocks):
    ids, label, vectors = make(n=120, copies=1, spread=0.02, dim=8)
    vectors[3] = vectors[4] if label[3] == label[4] else vectors[3]
    label = [int(y) for y in label]
    keep = [i for i in range(120) if i != 3]
    items = frame(spark, ids[keep], [label[i] for i in keep], vectors[keep])
    assert V.tar_at_far_sampled(items, (0.01,)).first().tar > 0.95


GOLDEN = {
    "0.001": (0.221072, [.07, .244, .37, .574], {0.001: (0.000724, 0.378870), 0.01: (0.008687, 0.287757), 0.1: (0.099662, 0.161167)}),
    "0.01": (0.259215, [.096, .284, .426, .656], {0.001: (0.000972, 0.377081), 0.01: (0.011909, 0.287910), 0.1: (0.103370, 0.161441)}),
}


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_golden_numbers(spark, sf):
    mrr, topk, tar = GOLDEN[sf]
    items = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    ranks = R.identity_rank(items).cache()
    assert R.mean_reciprocal_rank(ranks).first().mrr == pytest.approx(mrr, abs=1e-6)
    assert [r.accuracy for r in R.topk_accuracy(ranks).orderBy("k").collect()] == pytest.approx(topk)
    for row in V.tar_at_far(items).collect():
        assert (row.tar, row.threshold) == pytest.approx(tar[row.far], abs=1e-6)


def test_evaluation_gates(spark):
    rows = [(1, "a", True, [1.0, 0.0]), (2, "a", False, [1.0, 0.0]), (3, None, True, [0.0, 1.0]), (4, "b", True, [0.6, 0.8])]
    probes = spark.createDataFrame(rows, "id long, identity_gt string, has_pred boolean, embedding array<float>")
    results = E.evaluate(probes)
    assert {r.id: r.identity_rank for r in results.collect()} == {1: None, 2: None, 3: None, 4: None}
    m = E.detection_metrics(results).first()
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((0.5, 2 / 3, 2 / 3))
    failures = {(r.category, r.id) for r in E.failure_tables(results).collect()}
    assert failures == {("missed_detections", 2), ("false_positives", 3), ("wrong_identities", 1), ("wrong_identities", 4)}


def test_truthy_labels_drop_identity_zero(spark):
    rows = [(1, 0, True, [1.0, 0.0]), (2, 0, True, [1.0, 0.1]), (3, 5, True, [0.0, 1.0]), (4, 5, True, [0.1, 1.0])]
    probes = spark.createDataFrame(rows, "id long, identity_gt int, has_pred boolean, embedding array<float>")
    assert E.evaluate(probes).filter("identity_rank = 1").count() == 4
    assert E.evaluate(probes, truthy_labels=True).filter("identity_rank = 1").count() == 2


def test_empty_results(spark):
    empty = spark.createDataFrame([], "has_animal_gt boolean, has_animal_pred boolean, identity_rank long")
    assert E.detection_metrics(empty).first().accuracy == 0.0
    assert R.mean_reciprocal_rank(empty).first().mrr == 0.0
    assert {r.accuracy for r in R.topk_accuracy(empty).collect()} == {0.0}


def test_heads(spark, small_blocks):
    rng = np.random.default_rng(3)
    items = frame(spark, range(40), rng.integers(0, 6, 40), rng.normal(size=(40, 5)).astype(np.float32))
    single = H.class_means(items)
    arc = {(r.id, r["class"]): r.logit for r in H.head_logits(items, single, H.ARCFACE).collect()}
    sub = {(r.id, r["class"]): r.logit for r in H.head_logits(items, single, H.Head(angular_margin=0.5, centers=1)).collect()}
    assert arc == sub and len(arc) == 240
    plain = {(r.id, r["class"]): (r.logit, r.is_target) for r in H.prototype_logits(items, single).collect()}
    for r in H.head_logits(items, single, H.COSFACE).collect():
        cosine, target = plain[r.id, r["class"]]
        assert r.logit == pytest.approx((cosine - 0.35 * target) * 30)


def test_triplet_loss_cases(spark):
    easy = frame(spark, [1, 2, 3], [0, 0, 1], np.array([[0, 1], [0.1, 0.9], [1, 0]], np.float32))
    hard = frame(spark, [1, 2, 3], [0, 0, 1], np.array([[0, 0], [0.5, 0], [0.2, 0]], np.float32))
    triplet = spark.createDataFrame([(1, 2, 3)], "anchor long, positive long, negative long")
    assert H.triplet_loss(triplet, easy).first().loss == 0.0
    assert H.triplet_loss(triplet, hard).first().loss == pytest.approx(1.3, abs=1e-5)


def test_smoothed_cross_entropy_matches_formula(spark, small_blocks):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 4, 60)
    vectors = rng.normal(size=(60, 5)).astype(np.float32)
    items = frame(spark, range(60), label, vectors)
    protos = H.class_means(items)
    weights = {r.id: np.array(r.embedding) for r in protos.collect()}
    w = np.stack([weights[k] / np.linalg.norm(weights[k]) for k in range(4)])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    logits = H.COSFACE.logits(unit @ w.T, np.eye(4, dtype=bool)[label])
    logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    loss = (-0.9 * logp[np.arange(60), label] - 0.1 * logp.mean(axis=1)).mean()
    assert H.smoothed_cross_entropy(items, protos, H.COSFACE).first().loss == pytest.approx(loss, abs=1e-6)


def test_plans_have_no_cross_join_and_no_broadcast_of_vectors(items):
    plan = R.topk_neighbors(items, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_missing_and_ragged_vectors(spark):
    schema = "id long, label int, embedding array<float>"
    good = [(i, i % 2, [float(i), 1.0, 2.0]) for i in range(8)]
    some = spark.createDataFrame(good + [(9, 1, None)], schema)
    rows = R.topk_neighbors(some, 3).collect()
    assert {r.probe_id for r in rows} == set(range(8)) and all(r.gallery_id != 9 for r in rows)
    ragged = spark.createDataFrame(good + [(9, 1, [1.0, 2.0])], schema)
    with pytest.raises(Exception, match="of one length"):
        R.topk_neighbors(ragged, 3).collect()


def test_copies_per_row_are_bounded():
    held = tiles.HELD_BLOCKS * tiles.BLOCK_ROWS
    for rows in (1, 10_000, 10 ** 6, 10 ** 8, 10 ** 10):
        assert tiles.block_count(rows) <= tiles.SPREAD + rows / held + 1


def test_tile_numbers_beyond_32_bits(spark):
    far = spark.createDataFrame([(50_000 * 50_000 - 1,)], "_t long")
    assert 0 <= far.select(tiles.partition_of(tiles.MAX_TASKS)).first()[0] < tiles.MAX_TASKS


def test_class_means_are_sums_of_batches(spark, monkeypatch):
    """Labels of any type, batches smaller than a label, centres, rows without a label or a vector."""
    monkeypatch.setattr(H, "HELD_LABELS", 7)
    ids, label, vectors = make(n=120)
    rows = [(int(i), f"dog {y}", [float(x) for x in v]) for i, y, v in zip(ids, label, vectors)]
    items = spark.createDataFrame([*rows, (999, None, [1.0] * 6), (998, "dog 1", None)], "id long, label string, embedding array<float>").repartition(4)
    means = {r.id: r.embedding for r in H.class_means(items).collect()}
    assert set(means) == {f"dog {y}" for y in set(label.tolist())}
    for name, mean in means.items():
        mine = vectors[np.array([f"dog {y}" == name for y in label])].astype(float)
        assert np.allclose(mean, mine.mean(0), atol=1e-12)
    parts = H.class_means(items, F.col("id") % 3).collect()
    assert len(parts) == len({(y, int(i) % 3) for i, y in zip(ids, label)})
    for r in parts:
        mine = vectors[[f"dog {y}" == r.id and i % 3 == r.center for i, y in zip(ids, label)]].astype(float)
        assert np.allclose(r.embedding, mine.mean(0), atol=1e-12)
    assert H.class_means(items.limit(0)).count() == 0


@pytest.mark.parametrize("head", [H.ARCFACE, H.COSFACE, H.Head(scale=5000.0)])
def test_head_summary_adds_up_over_blocks(spark, small_blocks, data, items, head):
    """Log-sum-exp, target and best classes from partial rows, also where plain exponentials overflow."""
    prototypes = H.class_means(items.withColumn("label", F.col("id") % 90)).cache()
    rows = {r.id: r for r in H.head_summary(items, prototypes, head, 4).collect()}
    ids, label, vectors = data
    table = prototypes.collect()
    classes = np.array([r.id for r in table])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    cosine = unit(vectors.astype(float)) @ unit(np.array([r.embedding for r in table])).T
    z = head.logits(cosine, label[:, None] == classes[None, :])
    for i, key in enumerate(ids.tolist()):
        r, top = rows[key], z[i].max()
        assert r.lse == pytest.approx(top + np.log(np.exp(z[i] - top).sum()), abs=1e-7)
        own = z[i][classes == label[i]]
        assert (r.target is None) == (not len(own)) and (not len(own) or r.target == pytest.approx(own[0], abs=1e-9))
        assert [b.logit for b in r.best] == pytest.approx(sorted(z[i], reverse=True)[:4], abs=1e-9)


def test_search_by_cells_is_chosen_where_it_pays(spark, monkeypatch):
    """Decided on a sample before any search: tight groups use the tree, others do not."""
    rng = np.random.default_rng(5)
    centres = np.eye(40)[:, :40]
    tight = np.concatenate([c0 + 0.01 * rng.normal(size=(60, 40)) for c0 in centres]).astype(np.float32)
    loose = rng.normal(size=(1500, 40)).astype(np.float32)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    tight = tight[rng.permutation(len(tight))]
    assert pruned.passing_share(unit(tight), len(tight), 5) < pruned.WORTHWHILE < pruned.passing_share(unit(loose), len(loose), 5)
    used = []
    plain, tree = pruned.topk_neighbors, pruned.by_tree
    monkeypatch.setattr(pruned, "topk_neighbors", lambda *a, **k: used.append("plain") or plain(*a, **k))
    monkeypatch.setattr(pruned, "by_tree", lambda *a, **k: used.append("tree") or tree(*a, **k))
    for vectors in (tight, loose):
        items = frame(spark, range(len(vectors)), [0] * len(vectors), vectors)
        got = {tuple(r) for r in pruned.topk_neighbors_pruned(items, 5).collect()}
        want = {tuple(r) for r in R.topk_neighbors(items.select("id", "embedding"), 5).collect()}
        assert got == want
    assert used == ["tree", "plain"]


def test_the_decision_is_made_on_vectors_that_are_no_pivots():
    """A sample of some vectors per part, most of them sub-pivots: their own angle of 0 is not that of the others."""
    vectors = np.random.default_rng(6).normal(size=(1717, 64))
    sample = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert pruned.passing_share(sample, 10_256, 5) > pruned.WORTHWHILE


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_a_probe_is_sent_to_a_cell_once(spark, small_blocks, monkeypatch, spread):
    ids, label, vectors = make(seed=4, n=260, copies=60, spread=spread)
    vectors[7:20] = 0
    vectors[21:23] = np.nan
    items = frame(spark, ids, label, vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    tree, seen = pruned.Tree(unit[np.isfinite(unit).all(axis=1)].astype(float), len(ids)), {}
    plain = pruned.materialize
    monkeypatch.setattr(pruned, "materialize", lambda df, name: seen.setdefault(name, plain(df, name)))
    got = pruned.by_tree(items, 4, None, tree).collect()
    want = R.topk_neighbors(items.select("id", "embedding"), 4).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == {tuple(r) for r in want}
    visits = seen["pruned-visits"]
    assert visits.count() == visits.select("id", "cell").distinct().count() > 0
    assert visits.agg(F.max("cell")).first()[0] < len(tree.pivots)
