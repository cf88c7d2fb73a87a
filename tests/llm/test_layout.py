"""Resharding and packing."""

import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pelage.llm import packing, resharding
from pelage.llm.registry import QUERIES
import pelage.llm.catalog  # noqa: F401

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_flow_moves_the_fewest_bytes():
    flow = resharding.min_cost_flow([10, 3, 2], [5, 5, 5], lambda i, j: int(i != j))
    assert sum(flow.values()) == 15 and sum(n for (i, j), n in flow.items() if i != j) == 5
    # A longer way round is taken where it is cheaper.
    cost = [[4, 1], [2, 9]]
    assert resharding.min_cost_flow([2, 2], [2, 2], lambda i, j: cost[i][j]) == {(0, 1): 2, (1, 0): 2}


@pytest.mark.parametrize("fixture, rows", [("edge_docs", 20), ("null_row_docs", 4), ("no_docs", 0)])
def test_plan_places_every_row(request, fixture, rows):
    docs = request.getfixturevalue(fixture)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    placed = resharding.plan(docs, F.col("doc_id"), size, F.crc32(F.coalesce("source", F.lit("")).cast("binary")), 4, 3)
    done = resharding.slots(placed, 3).toPandas()
    assert len(done) == rows and done["shard"].between(0, 2).all()
    for _, part in done.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sum(r.docs for r in resharding.transfers(placed).collect()) == rows


def moved_least(supply, room):
    """Fewest bytes that must move: what a shard holds beyond its new capacity, and all of one that goes."""
    return sum(max(0, n - (room[i] if i < len(room) else 0)) for i, n in enumerate(supply))


def test_flow_moves_no_more_than_it_must():
    r = random.Random(8)
    for _ in range(60):
        old, new = r.randint(1, 6), r.randint(1, 6)
        supply = [r.randint(0, 40) for _ in range(old)]
        room = resharding.near_equal(sum(supply), new)
        flow = resharding.min_cost_flow(supply, room, lambda i, j: int(i != j))
        assert sum(n for (i, j), n in flow.items() if i != j) == moved_least(supply, room)


def test_flow_of_any_costs_is_the_cheapest():
    """Against all ways to deal out three sources of a few bytes."""
    r = random.Random(9)

    def ways(supply, room):
        if not supply:
            yield []
            return
        for split in itertools.product(*[range(min(supply[0], x) + 1) for x in room]):
            if sum(split) == supply[0]:
                for rest in ways(supply[1:], [x - y for x, y in zip(room, split)]):
                    yield [split, *rest]

    for _ in range(12):
        supply = [r.randint(0, 3) for _ in range(3)]
        room = resharding.near_equal(sum(supply), 3)
        cost = [[r.randint(0, 9) for _ in range(3)] for _ in range(3)]
        flow = resharding.min_cost_flow(supply, room, lambda i, j: cost[i][j])
        paid = sum(cost[i][j] * n for (i, j), n in flow.items())
        assert paid == min(sum(cost[i][j] * n for i, row in enumerate(w) for j, n in enumerate(row)) for w in ways(supply, room))


def test_layout_after_rewriting_holds_every_document(spark, tmp_path):
    """Files of touched shards and old files of the others together are the corpus; columns of any name stay."""
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"),
        *[F.lit("own").alias(k) for k in ("_key", "key", "shard", "row", "_own", "_to", "old", "size")])
    old = F.when(F.col("doc_id") < 100, F.lit(0)).when(F.col("doc_id") < 200, F.lit(1)).otherwise(F.lit(2))
    size = F.octet_length("text") + 8
    placed = resharding.plan(docs, F.col("doc_id"), size, old, 3, 4).persist()
    assert sorted({r.row["_key"] for r in placed.collect()}) == ["own"]
    path = str(tmp_path / "out")
    resharding.rewrite(docs, F.col("doc_id"), placed, path)
    found = resharding.layout(docs, F.col("doc_id"), placed, path)
    assert found.columns == [*docs.columns, "_shard"] and set(found.select("shard").distinct().toPandas()["shard"]) == {"own"}
    want = {r.key: r.shard for r in placed.collect()}
    assert {r.doc_id: r._shard for r in found.collect()} == want and len(want) == 400
    supply = [r.n for r in placed.groupBy("old").agg(F.sum("size").alias("n")).orderBy("old").collect()]
    moved = placed.where("old <> shard").agg(F.sum("size")).first()[0]
    # Documents are whole: each transfer may be off by one of them at either end.
    assert abs(moved - moved_least(supply, resharding.near_equal(sum(supply), 4))) <= 2 * 12 * 106


def test_rewrite_touches_what_moves(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 3).alias("old"))
    placed = resharding.plan(docs, F.col("doc_id"), F.lit(10), F.when(F.col("old") == 2, 1).otherwise(F.col("old")), 3, 3)
    manifest = resharding.rewrite(docs, F.col("doc_id"), placed, str(tmp_path / "out")).collect()
    assert {r.shard for r in manifest} == {1, 2} and sum(r.docs for r in manifest) == 200


def test_resharding_query(spark, given):
    rows = QUERIES["op6_resharding"](spark, SF_DIR).toPandas()
    texts = dict(given)
    assert len(rows) == len(given) and set(rows["law"]) == {"bytes"}
    for r in rows.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    sizes = rows.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= rows["size"].max()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_fast_ids_equal_those_of_the_vocabulary():
    slow = packing.TextIds(PATH)
    fast = packing.TextIds(PATH, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    r = random.Random(3)
    parts = [" ", "  ", "\n", "a", "é", "12", "!", "'s", " the", "\t", " \n", "<|endoftext|>", "don't", ".", "\x1c", "中", "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(8000)]
    for text in [*texts, " " * 5000 + "x", "a" * 5000]:
        assert fast(text) == slow(text)


def test_added_tokens_keep_their_id():
    """Ids as those of the tokenizer as it is loaded, on both paths."""
    tokenizer = Tokenizer.from_file(PATH)
    slow = packing.TextIds(PATH)
    fast = packing.TextIds(PATH, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert np.frombuffer(fast("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext |>", "<|endoftext|", " é\n<|endoftext|>\n"):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert fast(text) == slow(text) == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    r = random.Random(1)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 60)}
    capacity = packing.Capacity(tokens=100, docs=6, cost=6000, rule=rule)
    with pytest.raises(ValueError):
        packing.best_fit({90: 1}, capacity)
    counts = {n: k for n, k in counts.items() if n * n <= 6000}
    groups = packing.best_fit(counts, capacity)
    placed = {}
    for g in groups:
        assert sum(n * k for n, k in g.lengths) <= 100 and sum(k for _, k in g.lengths) <= 6
        assert sum(n * n * k for n, k in g.lengths) <= 6000
        for n, k in g.lengths:
            placed[n] = placed.get(n, 0) + k * g.count
    assert placed == counts


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    for (key, text), part in zip(texts, (rows[rows.doc_id == k].sort_values("piece") for k, _ in texts)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert list(part["piece"]) == list(range(len(part))) and part["length"].sum() == len(ids)
        assert (part["length"].iloc[1:] == 1024).all()
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 1024


def test_packing_query(spark, given):
    rows = QUERIES["op10_packing"](spark, SF_DIR).toPandas()
    assert set(rows["doc_id"]) == {k for k, _ in given}
    check_packed(rows, given)
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 1024) + 3


def test_packing_edge_cases_and_round_trip(edge_docs, edge_texts, null_row_docs, no_docs):
    pieces = packing.tokenized(edge_docs, "doc_id", "text", PATH, 2, 1024, with_ids=True)
    placed = packing.packed(pieces)
    rows = placed.drop("ids").withColumnRenamed("id", "doc_id").toPandas()
    twice = rows[rows.doc_id == 6]
    assert len(twice) == 2
    check_packed(rows.drop_duplicates(["doc_id", "piece"])[lambda x: x.doc_id != 6].pipe(
        lambda x: x[~x.sequence_id.isin(twice.sequence_id)]), [])
    total = sum(len(r.ids) // 4 for r in packing.sequences(placed).collect())
    assert total == rows["length"].sum()
    assert packing.packed(packing.tokenized(null_row_docs, "doc_id", "text", PATH, 2, 1024)).count() == 4
    assert packing.packed(packing.tokenized(no_docs, "doc_id", "text", PATH, 2, 1024)).count() == 0
