"""Importance resampling by joined batches, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA, SF_DIR, prose, rows_of

import pelage.llm.catalog  # noqa: F401
from pelage.llm import batch_resample as br
from pelage.llm.registry import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000
                        for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, targets, seed=2024, percent=10, least=20, longest=1):
    """[(id, features, weight, score, rank)]; ``docs`` are (id, text)."""
    own = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in targets for b in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, words, f in own:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, words, len(f), weight, score))
    order = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    drawn = order[:percent * len(order) // 100]
    out = [(r[0], r[2], r[3], r[4], k) for k, r in enumerate(drawn, 1)]
    rest = Counter(rows) - Counter(drawn)
    return out + [(r[0], r[2], r[3], r[4], None) for r in rest.elements()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def run(spark, docs, targets, longest=1, percent=10):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    weighted = br.weights(docs, "doc_id", "text", target, "text", br.Features(longest=longest))
    rows = br.drawn(br.scored(weighted, 2024), percent, 20)
    return [(r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows.collect()]


def test_query_against_plain_python(spark, given):
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("text").collect()]
    got = [tuple(r) for r in QUERIES["op13_batch_resample"](spark, SF_DIR).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert ordered(got) == ordered(plain(given, items))


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("percent", [0, 10, 55, 100])
def test_edge_cases(spark, edge_docs, edge_texts, longest, percent):
    texts = [*enumerate(edge_texts), (6, edge_texts[6])]
    targets = [prose(3, 40), None, "", "one two É"]
    assert ordered(run(spark, edge_docs, targets, longest, percent)) == ordered(plain(texts, targets, percent=percent, longest=longest))


def test_batches_keep_documents_apart():
    """N-grams never cross documents, wherever batches are cut and whatever bytes the texts hold."""
    texts = ["a b c", "", None, "b\x00c a", "\x00", "É é\xa0x", "a-b_c9", "ABC abc", "c", "a b c"]
    known = br._Buckets(10000)
    for cut in range(len(texts) + 1):
        got = [[] for _ in texts]
        for first, part in ((0, texts[:cut]), (cut, texts[cut:])):
            for docs, buckets in br.batch_features(pa.array(part, pa.string()), br.Features(longest=3), known):
                for d, b in zip(docs, buckets):
                    got[first + d].append(b)
        assert [sorted(g) for g in got] == [sorted(features(t, 3)[1]) for t in texts]


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(br, "KNOWN_WORDS", 4)
    text = " ".join(f"w{i}" for i in range(50))
    (_, buckets), = br.batch_features(pa.array([text, text]), br.Features(), br._Buckets(10000))
    assert buckets.tolist() == features(text)[1] * 2


def test_null_rows_empty_tables_and_no_target(spark, null_row_docs, no_docs):
    rows = run(spark, null_row_docs, [])
    assert len(rows) == 4 and [r[3:] for r in rows if r[0] is None] == [(None, None)] * 2
    assert ordered(rows) == ordered(plain([(None, None), (None, None), (0, prose(1, 60)), (1, prose(1, 60))], []))
    assert run(spark, no_docs, ["x"]) == []


def test_ranks_run_through_ties(spark):
    """One id in many rows: equal scores are numbered one after the other."""
    docs = spark.createDataFrame([*rows_of([prose(1, 30)] * 40), *[rows_of([prose(1, 30)])[0]] * 60], SCHEMA).repartition(7)
    rows = run(spark, docs, [prose(1, 30)], percent=90)
    ranks = sorted(r[4] for r in rows if r[4] is not None)
    assert ranks == list(range(1, 91)) and len(rows) == 100
    in_order = [r for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])]
    assert all((-a[3], a[0]) <= (-b[3], b[0]) for a, b in zip(in_order, in_order[1:]))


def test_draw_follows_the_weights(spark):
    """Over many seeds a document's inclusion rate rises with its weight and is neither 0 nor 1."""
    target, other = prose(1, 40), prose(2, 40)
    docs = spark.createDataFrame(rows_of([target if i % 2 else other for i in range(200)]), SCHEMA)
    items = spark.createDataFrame([(0, target)], "item_id long, text string")
    weighted = br.weights(docs, "doc_id", "text", items, "text")
    share = []
    for seed in range(4):
        ids = [r["id"] for r in br.drawn(br.scored(weighted, seed), 30, 20).where("rank is not null").collect()]
        assert len(ids) == 60
        share.append(np.mean([i % 2 for i in ids]))
    assert 0.5 < np.mean(share)
