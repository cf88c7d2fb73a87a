"""Parity-sketch join against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR, SCHEMA, prose, rows_of

from pelage.llm import components as components_module
from pelage.llm import jaccard_join
from pelage.llm.hashing import mix
from pelage.llm.registry import QUERIES
from pelage.llm.storage import stored
import pelage.llm.catalog  # noqa: F401


def test_linked_sets_share_a_piece():
    bands = jaccard_join.Bands(85)
    rng = np.random.default_rng(2)
    for size in [*range(1, 60), 150, 700]:
        for _ in range(6):
            a = np.unique(mix(rng.integers(1, 1 << 40, size).astype(np.uint64)))
            gone = rng.integers(0, max(1, int(0.15 * len(a))) + 1)
            b = a[gone:]
            if 100 * len(b) >= 85 * len(a):
                assert set(jaccard_join.piece_keys(a, bands)) & set(jaccard_join.piece_keys(b, bands)), (size, gone)


def test_edge_cases(edge_docs, edge_rows):
    rows = {r.id: (r.n_shingles, r.component) for r in jaccard_join.similar_groups(edge_docs).collect()}
    assert rows == brute.similar([(r[0], r[1]) for r in edge_rows], 4, 85)


@pytest.mark.parametrize("block", [2048, 8])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(4)
    base = prose(9, 90).split()
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    rows = {x.id: (x.n_shingles, x.component) for x in jaccard_join.similar_groups(docs).collect()}
    assert rows == brute.similar(list(enumerate(texts)), 4, 85)


def test_null_rows_and_empty(null_row_docs, no_docs):
    assert sorted((r.id, r.component) for r in jaccard_join.similar_groups(null_row_docs).collect()) == [(0, 0), (1, 0)]
    assert jaccard_join.similar_groups(no_docs).count() == 0


def test_query(spark, given):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard_join"](spark, SF_DIR).collect()}
    assert rows == brute.similar(given, 4, 85)


def test_an_id_with_several_texts_has_one_set(spark):
    """Size, fingerprints and tokens are those of the same text, the first by size and fingerprint."""
    rows, docs = [], []
    for i in range(40):
        shared, other = prose(100 + i, 60), prose(200 + i, 60)
        rows += [(2 * i, shared), (2 * i, other), (2 * i + 1, shared)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["x"] * 13) for i, t in rows], SCHEMA).repartition(4)
    first = {}
    for i, text in rows:
        found = jaccard_join.shingle_sets(pa.array([text]), 4)
        order = tuple(v[0].as_py() for v in jaccard_join._measures(found).values())
        first[i] = min(first.get(i, (order, text)), (order, text))
    want = brute.similar([(i, text) for i, (_, text) in first.items()], 4, 85)
    assert {r.id: (r.n_shingles, r.component) for r in jaccard_join.similar_groups(docs).collect()} == want
    assert 5 < sum(i != low for i, (_, low) in want.items()) < 35


def test_two_thousand_near_copies_that_do_not_all_link(spark):
    """Pairs around the limit in one group: links decide, and the second pass lists few of the pairs."""
    r = random.Random(11)
    base = prose(12, 120).split()
    texts = []
    for i in range(2000):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 5, 6])):
            words[r.randrange(len(words))] = f"w{r.randrange(400)}"
        texts.append(" ".join(words))
    sets = jaccard_join.shingle_sets(pa.array(texts), 4)
    vocabulary = np.unique(np.concatenate(sets))
    held = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        held[i, np.searchsorted(vocabulary, s)] = 1
    common = held @ held.T
    n = held.sum(1)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    want = brute.groups([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(linked, 1)))], range(len(texts)))
    assert not linked.all() and len(set(want.values())) > 1
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(8)
    assert {x.id: x.component for x in jaccard_join.similar_groups(docs).collect()} == want


def test_sketches_grow_with_the_sets():
    """No ceiling: the sketch of a large band has eight bits for each difference that is allowed."""
    bands = jaccard_join.Bands(80)
    for n in (10, 1000, 30_000, 400_000):
        band = bands.band(n)
        assert bands.bits(band) >= 8 * bands.difference(2 * bands.largest(band))
    rng = np.random.default_rng(1)
    a, b = (np.unique(mix(rng.integers(1, 1 << 40, 20_000).astype(np.uint64))) for _ in range(2))
    bits = [np.unpackbits(np.frombuffer(jaccard_join.bit_sketch(x, bands.bits(bands.band(len(x)))), np.uint8)) for x in (a, b)]
    assert (bits[0] ^ bits[1]).sum() > bands.difference(len(a) + len(b))


@pytest.fixture
def written(monkeypatch):
    """Names of the steps that the join and its components write."""
    names = []

    def noted(df, name):
        names.append(name)
        return stored(df, name)

    monkeypatch.setattr(jaccard_join, "stored", noted)
    monkeypatch.setattr(components_module, "stored", noted)
    return names


def test_stars_take_no_round(spark, written):
    edges = [(1, 5), (5, 1), (7, 1), (-4, 9), (3, 3)]
    found = components_module.components(spark.createDataFrame(edges, "a long, b long"), "star")
    assert sorted(map(tuple, found.collect())) == [(-4, -4), (1, 1), (5, 1), (7, 1), (9, -4)]
    assert written == ["star-edges"]


def test_components_of_random_graphs(spark):
    r = random.Random(12)
    edges = [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(130)] + [(x, x + 1) for x in range(1000, 1040)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = components_module.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(root.items())


def test_steps_that_have_nothing_to_do_are_left_out(spark, written):
    base = prose(21, 60)
    texts = [base, f"{base} end", *(prose(i, 60) for i in range(30, 36))]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = {x.id: x.component for x in jaccard_join.similar_groups(docs).collect()}
    assert found == {0: 0, 1: 0, **{i: i for i in range(2, 8)}}
    assert written.count("jaccard-pairs") == 2 and not {"jaccard-left", "jaccard-concerned", "jaccard-first-round"} & set(written)


def test_buckets_are_written_before_they_are_compared(spark, written):
    """One plan for both is planned anew by the driver after each of its many stages."""
    base = prose(22, 60)
    docs = spark.createDataFrame(rows_of([base, f"{base} end", *(prose(i, 60) for i in range(40, 44))]), SCHEMA)
    found = {x.id: x.component for x in jaccard_join.similar_groups(docs).collect()}
    assert found == {0: 0, 1: 0, **{i: i for i in range(2, 6)}}
    assert written.count("jaccard-buckets") == 2
