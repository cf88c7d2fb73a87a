"""Suffix-array dedup on bytes and De Bruijn dedup on words against brute force."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from pelage.llm import repeated_spans, suffix_blocks, suffix_dedup
from pelage.llm.registry import QUERIES
import pelage.llm.catalog  # noqa: F401


def texts_of(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def by_bytes(df):
    rows = df.where("id IS NOT NULL").select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(tuple(r) for r in rows)


def by_words(df):
    rows = df.where("id IS NOT NULL").select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(tuple(r) for r in rows)


def test_block_sort_is_lexicographic():
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, rng.integers(1, 150)).astype(np.uint8) for _ in range(5)]
    text = np.concatenate([parts[i] for i in rng.integers(0, 5, 50)])
    order = np.concatenate(list(suffix_blocks.Block(text).sorted_buckets(np.arange(len(text)))))
    data = text.tobytes() + bytes(200)
    assert sorted(order) == list(range(len(text)))
    assert all(data[a:a + 62] <= data[b:b + 62] for a, b in zip(order, order[1:]))


def test_bytes_edge_cases(edge_docs, edge_rows):
    assert by_bytes(suffix_dedup.remove_repeats(edge_docs)) == brute.removed_bytes(texts_of(edge_rows))


def test_bytes_crowded_pins(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)
    assert by_bytes(suffix_dedup.remove_repeats(edge_docs)) == brute.removed_bytes(texts_of(edge_rows))


def test_bytes_null_rows_and_empty(null_row_docs, no_docs):
    rows = suffix_dedup.remove_repeats(null_row_docs).collect()
    assert sorted((r.id is None, r.n_removed > 0) for r in rows) == [(False, False), (False, True), (True, False), (True, False)]
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_words_edge_cases(edge_docs, edge_rows):
    assert by_words(repeated_spans.remove_repeats(edge_docs)) == brute.removed_words(texts_of(edge_rows))


def test_words_null_rows_and_empty(null_row_docs, no_docs):
    assert repeated_spans.remove_repeats(null_row_docs).count() == 4
    assert repeated_spans.remove_repeats(no_docs).count() == 0


def test_paths_point_to_their_source(edge_docs, edge_texts):
    rows = repeated_spans.remove_repeats(edge_docs).where("size(paths) > 0").collect()
    assert rows
    for row in rows:
        words = edge_texts[row.id].encode().split()
        for p in row.paths:
            source = edge_texts[p.source].encode().split()
            assert words[p.start:p.end] == source[p.source_start:p.source_start + p.end - p.start]


@pytest.mark.parametrize("name, expected", [
    ("op5_suffix_dedup", brute.removed_bytes), ("op9_repeated_spans", brute.removed_words)])
def test_queries(spark, given, name, expected):
    df = QUERIES[name](spark, SF_DIR)
    columns = df.columns[:5] if name.startswith("op5") else df.columns[:4]
    assert sorted(tuple(r) for r in df.select(columns).collect()) == expected(given)


@pytest.mark.parametrize("length", [10, 31, 63, 100])
def test_lengths_that_the_ranks_do_not_hold_for_are_refused(edge_docs, length):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(edge_docs, length=length)


def test_strings_with_one_pin_are_hashed_and_looked_up_once(monkeypatch):
    """Work per run of strings, not per string; texts of exactly, under and over the length beside each other."""
    looked = []
    plain = suffix_dedup.member
    monkeypatch.setattr(suffix_dedup, "member", lambda keys, doc, values: looked.append(len(values)) or plain(keys, doc, values))
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (50, 0, 49, 400, 51, 1, 3000, 50)]
    own = next(suffix_dedup._pins(iter([pa.RecordBatch.from_pydict({"id": list(range(8)), "text": [t.decode() for t in texts]})]), 50, 20))
    x = suffix_dedup.Contexts(texts, own.column("keys"), 50, 20)
    strings = [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    first = [sum(map(len, texts[:d])) for d in range(8)]
    got = [(d, s - first[d] + i) for d, s, n in zip(x.doc.tolist(), x.start.tolist(), x.n.tolist()) for i in range(n)]
    assert got == strings
    assert looked == [len(x.n)] and looked[0] < len(strings) / 5
