"""Concatenate and cut, against the tokenizer itself and by round trip."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR, rows_of, SCHEMA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import pelage.llm.catalog  # noqa: F401
from pelage.llm import concat_cut, packing
from pelage.llm.registry import QUERIES

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return Tokenizer.from_file(PATH)


def ids_of(vocabulary, text):
    return np.array(vocabulary.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check(rows, texts, vocabulary, size, tail):
    """Every id in one piece, windows gapless, whole windows full, the stream one run of documents."""
    total = 0
    for (key, text), part in zip(texts, (rows[rows.id == k].sort_values("start") for k, _ in texts)):
        ids = ids_of(vocabulary, text)
        assert list(part.start) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert (part.doc_tokens == len(ids)).all() and (part.length > 0).all()
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        total += len(ids)
    lengths = []
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]]
        lengths.append(int(part.length.sum()))
    whole, rest = divmod(total, size)
    want = [rest] if tail == "pad" and rest else [1 << b for b in range(20) if rest >> b & 1]
    assert sorted(lengths) == sorted([size] * whole + want)


@pytest.mark.parametrize("word_ends", ["</w>", None])
def test_ids_by_runs_equal_those_of_whole_texts(vocabulary, word_ends):
    """Random texts of white space of all sorts, combining marks, capitals, contractions and the added tokens."""
    known = concat_cut.RunIds(PATH, "<u4", word_ends)
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "a", "É", "E\u0301", "\u0301", "Σ", "ΑΣ", "\u0130", "ß", "12", "'s", "'LL", "don't", "!", "?!",
             "<|endoftext|>", "<|startoftext|>", "<|endoftext", "中文", "🙂", "\x00", "的", "x" * 60, "ñ", "ﬁ", "Ω", "\u212b", "\u1e9e", "Straße", "über", "×", "÷", "ª",
             "rendblean", "Antionston", "chle\xc3###", "{}", "~", "\x7f"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(8000)]
    for text, ids in zip(texts, known.texts([t.encode() for t in texts])):
        assert ids == np.array(vocabulary.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_ids_of_random_letters_equal(vocabulary):
    """Merges in their order: invented words of every length, on the fast path."""
    known = concat_cut.RunIds(PATH, "<u2")
    r = random.Random(6)
    syllables = ["th", "e", "an", "ti", "on", "st", "ble", "end", "ing", "é", "qu", "ou", "sch", "ä", "x", "'", "-", "7", "."]
    runs = ["".join(r.choice(syllables) for _ in range(r.randint(1, 12))) for _ in range(20000)]
    runs += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([3, 8, 30, 700]))) for _ in range(1000)]
    got = known.texts([x.encode() for x in runs])
    for run, ids in zip(runs, got):
        assert ids == np.array(vocabulary.encode(run, add_special_tokens=False).ids, "<u2").tobytes(), run


def test_memory_of_runs_is_bounded(monkeypatch, vocabulary):
    monkeypatch.setattr(concat_cut, "KNOWN_RUNS", 10)
    known = concat_cut.RunIds(PATH, "<u4")
    for i in range(5):
        text = " ".join(f"word{i}x{j} same" for j in range(20))
        assert known.texts([text.encode()]) == [np.array(vocabulary.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(known.known) <= 10 + 21 * 2


def test_query(spark, given, vocabulary):
    rows = QUERIES["op11_concat_cut"](spark, SF_DIR).toPandas().rename(columns={"doc_id": "id"})
    assert set(rows.id) == {k for k, _ in given}
    check(rows, given, vocabulary, 4096, "powers")


@pytest.mark.parametrize("tail", ["pad", "powers"])
def test_edge_cases(spark, edge_texts, vocabulary, tail):
    docs = spark.createDataFrame(rows_of(edge_texts), SCHEMA).repartition(5)
    tokens = concat_cut.tokenized(docs, "doc_id", "text", PATH, 2)
    rows = concat_cut.pieces(tokens, 64, tail).drop("ids").toPandas()
    check(rows, list(enumerate(edge_texts)), vocabulary, 64, tail)


def test_order_follows_the_partitions(spark, monkeypatch):
    """Blocks of partitions are summed one by one and put in line."""
    monkeypatch.setattr(concat_cut, "BLOCK_PARTS", 3)
    docs = spark.range(0, 100, numPartitions=11).select("id", F.repeat(F.lit("word "), F.col("id").cast("int")).alias("text"))
    rows = concat_cut.pieces(concat_cut.tokenized(docs, "id", "text", PATH, 2), 32).orderBy("sequence_id", "offset").toPandas()
    assert rows.id.is_monotonic_increasing
    place = rows.sequence_id * 32 + rows.offset
    assert list(place) == [0, *np.cumsum(rows.length)[:-1]]


def test_boundary_records_and_round_trip(spark, edge_docs, edge_texts, vocabulary):
    tokens = concat_cut.tokenized(edge_docs, "doc_id", "text", PATH, 2)
    cut = concat_cut.pieces(tokens, 128, with_ids=True).cache()
    windows = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(cut).collect()}
    stream = np.concatenate([windows[i] for i in sorted(windows)])
    order = [r.id for r in cut.where("start = 0").orderBy("sequence_id", "offset").collect()]
    texts = dict(enumerate(edge_texts))
    assert (stream == np.concatenate([ids_of(vocabulary, texts[i]) for i in order])).all()
    records = concat_cut.boundaries(cut).collect()
    inside = cut.where("offset = 0 and start > 0").count()
    assert len(records) == inside and all(r.tokens_before > 0 and r.tokens_after > 0 for r in records)


def test_null_rows_and_empty_tables(spark, null_row_docs, no_docs):
    rows = concat_cut.pieces(concat_cut.tokenized(null_row_docs, "doc_id", "text", PATH, 2), 4096).toPandas()
    assert len(rows) == 4 and rows.id.isna().sum() == 2 and set(rows[rows.id.isna()].length) == {1}
    assert concat_cut.pieces(concat_cut.tokenized(no_docs, "doc_id", "text", PATH, 2), 4096).count() == 0
    with pytest.raises(ValueError):
        concat_cut.edges(10, 4, "none")


@pytest.mark.parametrize("rest", range(0, 16))
def test_edges_of_the_last_windows(rest):
    assert list(concat_cut.edges(32 + rest, 16, "pad")) == ([32, 32 + rest] if rest else [32])
    lengths = np.diff(concat_cut.edges(32 + rest, 16, "powers"))
    assert lengths.sum() == rest and all(int(n).bit_count() == 1 for n in lengths)
