"""Multi-index near-dedup and importance resampling."""

import numpy as np
import pytest
from conftest import SCHEMA, SF_DIR, prose, rows_of
import brute

from pelage.llm import importance, multi_index
from pelage.llm.registry import QUERIES
import pelage.llm.catalog  # noqa: F401


def linked(vectors, threshold=0.93):
    """id -> (links, component) for (id, label, vector) rows."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(v)

    units = {i: (label, unit(v)) for i, label, v in vectors if i is not None}
    ids, links = sorted(units), []
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = units[a], units[b]
            if a != b and la is not None and la == lb and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links.append((a, b))
    component = brute.groups(links, ids)
    return {i: (sum(a == i for a, _ in links), component[i]) for i in ids}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(260):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.35)
        rows.append((i, i % 2, [float(x) for x in v]))
    copies = [(300 + i, 0, rows[0][2]) for i in range(40)]
    odd = [(400, 0, None), (401, 0, [0.0] * 16), (402, 0, [float("nan")] + [1.0] * 15), (403, None, rows[0][2]),
           (404, 0, [None] + [1.0] * 15), (405, 0, [float("inf")] * 16), (406, 0, rows[0][2][:8]), (407, 0, rows[0][2][:8]),
           (408, 0, [])]
    return rows + copies + odd


@pytest.mark.parametrize("recall, block", [(1.0, 4096), (1.0, 16), (0.999, 4096)])
def test_links_against_brute_force(spark, vectors, monkeypatch, recall, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    table = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, label int, embedding array<double>, cell string")
    found = multi_index.near_duplicates(table, target_recall=recall)
    want = linked(vectors)
    got = {r.id: (r.n_links, r.component) for r in found.collect()}
    if recall == 1.0:
        assert got == want
    else:
        assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def partners(cosine, n, seed=0, dims=64, groups=40):
    """Unit vectors in loose groups and a partner of each at exactly this cosine in a random direction."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 1.5 * rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(n, dims))
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine ** 2) * away])
    return [(i, 0, [float(x) for x in v]) for i, v in enumerate(both)]


@pytest.mark.parametrize("cosine", [0.9301, 0.95, 0.99])
def test_recall_of_partners_at_a_cosine(spark, cosine):
    """64 dimensions, links of every strictness; the exact setting finds all."""
    n = 700
    table = spark.createDataFrame(partners(cosine, n), "vec_id long, label int, embedding array<double>")
    found = {r.id: r.n_links for r in multi_index.near_duplicates(table).collect()}
    assert np.mean([found[i] >= 1 and found[i + n] >= 1 for i in range(n)]) >= 0.99
    exact = {r.id: r.n_links for r in multi_index.near_duplicates(table, target_recall=1.0).collect()}
    assert all(exact[i] >= 1 and exact[i + n] >= 1 for i in range(n))


def test_traversal_goes_from_near_to_far():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(400, 10))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    index = multi_index.Index(sample, 6, 0.9, 1.0)
    bounds = index.bounds(sample)
    home = index.cells(sample)
    for row, cells in index.visits(sample):
        cost = bounds[0][row][cells // len(index.books[1])] + bounds[1][row][cells % len(index.books[1])]
        assert (np.diff(cost) >= 0).all() and len(set(cells)) == len(cells) and cells[0] == home[row]


def test_vectors_null_rows_and_empty(spark):
    table = spark.createDataFrame([(None, None, None), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.id or 0, r.n_links) for r in multi_index.near_duplicates(table).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert multi_index.near_duplicates(table.limit(0)).count() == 0


def test_importance_held_out(spark):
    """Labels of even ids fit the model; odd ids judge it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    sampler = importance.Sampler(docs, labels.where("doc_id % 2 = 0"))
    kept = {r.id: r.kept for r in sampler.decided().collect()}
    held = [(r.doc_id, r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [kept[i] for i, q in held if q == 1], [kept[i] for i, q in held if q == 0]
    assert len(kept) == 1000 and np.mean(good) >= 0.95 and np.mean(bad) <= 0.3
    assert sampler.keep(docs).count() == sum(kept.values())


def test_importance_rejects_held_out_toxic(spark):
    """Labels of one half of the ids fit the models; the other half judges what is drawn."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for half in (0, 1):
        sampler = importance.Sampler(docs, labels.where(f"doc_id % 2 = {half}"), reject_toxic=True)
        kept = {r.id: r.kept for r in sampler.decided().collect()}
        held = labels.where(f"doc_id % 2 <> {half}").collect()
        toxic, clean = ([kept[r.doc_id] for r in held if r.toxic == t and r.quality == 1] for t in (1, 0))
        # Six in ten of the toxic documents hold a word that only toxic ones hold.
        assert np.mean(toxic) <= 0.45 and np.mean(clean) >= 0.95
        assert {r.doc_id for r in sampler.keep(docs).collect()} == {i for i, k in kept.items() if k}


def test_one_toxic_word_decides_in_a_long_text(spark):
    texts = [f"{prose(i, 40)} {'vileword' if i % 2 else ''} {prose(500 + i, 40)}" for i in range(60)]
    texts += [f"{prose(900, 4000)} vileword {prose(901, 4000)}", f"{prose(900, 4000)} {prose(901, 4000)}"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in importance.Sampler(docs, labels, k=100, reject_toxic=True).keep(docs).collect()}
    assert kept == {*range(0, 60, 2), 61}
    assert importance.Sampler(docs, labels.where("toxic = 0"), k=100, reject_toxic=True).keep(docs).count() == 62


def test_importance_edge_cases(spark, edge_docs, null_row_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (10, 1, 0), (13, 0, 0), (14, 0, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, None)],
                                   "doc_id long, quality int, toxic int")
    sampler = importance.Sampler(edge_docs, labels)
    rows = sampler.decided().collect()
    assert len(rows) == 20 and all(r.log_ratio == 0 for r in rows if r.id in (0, 1, 2))
    assert {r.id for r in rows if r.kept} >= {6, 10} and not {13, 14} & {r.id for r in rows if r.kept}
    assert sampler.keep(edge_docs).columns == edge_docs.columns
    assert importance.Sampler(null_row_docs, labels).decided().count() == 4
    assert importance.Sampler(no_docs, labels).decided().count() == 0
    unlabelled = importance.Sampler(edge_docs, labels.limit(0))
    assert unlabelled.k == 0 and unlabelled.keep(edge_docs).count() == 0


def test_kth_code(spark):
    values = [5, 5, 5, -3, 10 ** 9, 7, -10 ** 12, 0]
    codes = spark.createDataFrame([(v,) for v in values], "code long")
    for k in range(1, len(values) + 1):
        assert importance.kth_code(codes, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_code(codes, 0) is None and importance.kth_code(codes.limit(0), 3) is None


def test_importance_draw_of_k(spark):
    docs = spark.createDataFrame(rows_of([prose(i, 30) for i in range(40)]), SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert importance.Sampler(docs, labels, k=15).keep(docs).count() == 15


def test_driver_gets_what_decides_only(spark, monkeypatch):
    """Labels are judged once for all samples, and no row comes for buckets that no toxic document has."""
    written, counts = [], []
    stored, models = importance.stored, importance.ToxicModels
    monkeypatch.setattr(importance, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    monkeypatch.setattr(importance, "ToxicModels", lambda table, *ids: (counts.append(table), models(table, *ids))[1])
    docs = spark.createDataFrame(rows_of([f"{prose(i, 40)} {'vileword' if i % 6 == 1 else ''}" for i in range(60)]), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, int(i % 6 == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    importance.Sampler(docs, labels, reject_toxic=True)
    assert written.count("importance-judged") == 1
    rows = counts[0].to_pylist()
    assert [(r["harmless"], r["toxic"]) for r in rows if r["bucket"] < 0] == [(50, 10)]
    assert len(rows) > 1 and all(r["toxic"] > 0 for r in rows)
