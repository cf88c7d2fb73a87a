"""What a task holds, sends or writes does not grow faster than its input."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pelage.operators import heads, negatives, retrieval, selection, tiles, verification
from pelage.plans import catalog, io_queries
from pelage.plans.bindings import Tables


def _items(spark, n, labels=4, seed=5, name=int):
    rng = np.random.default_rng(seed)
    rows = [(name(i), int(rng.integers(labels)), [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    kind = "long" if name is int else "string"
    return rows, spark.createDataFrame(rows, f"id {kind}, label int, embedding array<double>")


def _codes(rows):
    v = np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.rint(v @ v.T * tiles.SCALE).astype(np.int64)


@pytest.mark.parametrize("weighting", negatives.WEIGHTINGS)
@pytest.mark.parametrize("target", [150, 100_000])
def test_codes_of_sampled_pairs_need_no_vectors_per_pair(spark, monkeypatch, weighting, target):
    monkeypatch.setattr(negatives, "MEMBERS_PER_BLOCK", 16)
    rows, items = _items(spark, 60)
    sample = negatives.Negatives(items, target, 42, weighting)
    found = sample.codes()
    assert "embedding_low" not in found._jdf.queryExecution().toString()
    codes = _codes(rows)
    pairs = [(r["id_a"], r["id_b"]) for r in negatives.Negatives(items, target, 42, weighting).ids().collect()]
    assert sorted(r[0] for r in found.collect()) == sorted(int(codes[a, b]) for a, b in pairs)


@pytest.mark.parametrize("weighting", negatives.WEIGHTINGS)
@pytest.mark.parametrize("target", [700, 100_000])
def test_samples_of_very_many_pairs_are_marked_and_not_listed(spark, monkeypatch, weighting, target):
    """Several rounds of marking, then the last pairs slot by slot: the same codes as those of the listed pairs."""
    rows, items = _items(spark, 60)
    want = sorted(r[0] for r in negatives.Negatives(items, target, 42, weighting).codes().collect())
    for name, value in {"MARKED_FROM": 40, "MARKED_PER_TASK": 64, "MARKED_PER_ROUND": 256, "MARKED_BLOCK": 16, "MARKED_ROWS": 5}.items():
        monkeypatch.setattr(negatives, name, value)
    sample = negatives.Negatives(items, target, 42, weighting)
    monkeypatch.setattr(sample, "codes", lambda: pytest.fail("pairs are listed"))
    tiles_of = sample.histograms()
    total, found = selection.order_statistics(tiles_of, -tiles.SCALE - 10, tiles.SCALE + 11, lambda n: list(range(n)))
    assert total == len(want) and [found[i] for i in range(total)] == want


def test_packed_cells_are_the_cells():
    for cells in ([], [0], [255, 256], [3, 70_000, 1 << 25], sorted(np.random.default_rng(5).choice(1 << 20, 5_000, replace=False))):
        cells = np.array(cells, np.int64)
        assert negatives.unpacked_cells(len(cells), negatives.packed_cells(cells)).tolist() == cells.tolist()


def test_average_precision_copies_a_vector_once_per_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieval, "_LEVELS_PER_BLOCK", 64)
    plain = retrieval.streamed_tiles
    monkeypatch.setattr(retrieval, "streamed_tiles", lambda sides, tasks, *rest: seen.append(tasks) or plain(sides, tasks, *rest))
    rows, items = _items(spark, 200, labels=2)
    assert retrieval.average_precision(items).count() == 200
    assert seen == [2]


@pytest.mark.parametrize("name", [int, "id_{:03d}".format])
def test_a_tile_holds_the_best_rows_only(spark, monkeypatch, name):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 8)
    rows, items = _items(spark, 64, name=name)
    table = pa.table({"id": [r[0] for r in rows], "embedding": [r[2] for r in rows]})
    best, _ = retrieval.nearest_in_tile(items, items, 3)
    parts = tiles._meet(best, table, table, "embedding", False)
    assert sum(len(p["code"]) for p in parts) == 64 * 3
    codes = _codes(rows)
    np.fill_diagonal(codes, -2 * tiles.SCALE)
    expected = {rows[i][0]: [rows[j][0] for j in np.lexsort((np.arange(64), -codes[i]))[:3]] for i in range(64)}
    found: dict = {}
    for p in parts:
        for probe, other in zip(p["probe_id"].tolist(), p["gallery_id"].tolist()):
            found.setdefault(probe, []).append(other)
    assert found == expected


def test_equal_cells_by_sort():
    for kind in (int, str):
        left, right = np.array([3, 1, 2, 3]).astype(kind).astype(object), np.array([3, 3, 5, 1]).astype(kind).astype(object)
        cells = sorted(zip(*[x.tolist() for x in tiles.same_cells(left, right)]))
        assert cells == [(0, 0), (0, 1), (1, 3), (3, 0), (3, 1)]
    none = np.array([None, "a"], dtype=object)
    assert [x.tolist() for x in tiles.same_cells(none, none)] == [[0, 1], [0, 1]]


def test_vectors_without_numbers_are_nobodys_neighbour(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [float("nan"), 1.0]), (3, 2, [0.0, 1.0]), (4, 1, [1.0, 1.0]), (5, 2, [-1.0, 0.5])]
    items = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    found = retrieval.topk_neighbors(items, 2).collect()
    assert 2 not in {x for r in found for x in (r["probe_id"], r["gallery_id"])} and len(found) == 8
    assert {r["anchor"] for r in heads.triplets(items).collect()} == {1, 3, 4, 5}


@pytest.mark.parametrize("files", [1, 6])
def test_stream_reads_a_table_of_one_or_many_files(spark, tmp_path, files):
    rows, items = _items(spark, 40)
    folder = tmp_path / "embeddings.parquet"
    table = items.select(F.col("id").alias("vec_id"), "label", "embedding")
    if files == 1:
        table.toPandas().to_parquet(folder, index=False)
    else:
        table.repartition(files).write.parquet(str(folder))
    found = catalog.queries()["identify_stream"](spark, str(tmp_path))
    wanted = retrieval.topk_neighbors(items.select("id", "embedding"), 5)
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def _given(spark, tmp_path):
    orders = [(k, k % 3) for k in range(1, 13)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, k, k, 1, 5.0, 0.1, "ANR"[k % 3]) for k in range(1, 13)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    return Tables(spark, str(tmp_path))


def test_voc_documents_are_written_compressed(spark, tmp_path):
    t = _given(spark, tmp_path)
    path = io_queries._write_voc(t, F.col("ann_key")).removeprefix("file://").removeprefix("file:")
    files = [x for x in glob.glob(f"{path}/source=*/*") if "part-" in x]
    assert files and all(x.endswith(".gz") for x in files)
    assert io_queries.readers.read_voc_boxes(spark, "file://" + path).count() == 12


def test_scanned_files_take_no_blocks(spark, tmp_path):
    t = _given(spark, tmp_path)
    root = io_queries._folder_files(t, t.identities.select(F.col("file_path").alias("name")), "folders")
    files = [x for x in glob.glob(root.removeprefix("file:") + "/**", recursive=True) if os.path.isfile(x)]
    assert len(files) == 12 and sum(os.stat(x).st_blocks for x in files) == 0
    assert io_queries.readers.scan_identity_folders(spark, root).count() == 12
