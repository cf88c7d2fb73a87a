"""Similarity in tiles: block the vectors by id, pair the blocks, reduce in the task.

A tile holds one block of each side and returns only what the metric needs:
partial top-k rows, counts or histograms. No pair of vectors ever becomes a
row of its own unless the result asks for it. A block is up to
``HELD_BLOCKS * BLOCK_ROWS`` rows, so a vector is copied once per so many rows
of the other side; inside the task blocks meet piece by piece, and only one
matrix of ``BLOCK_ROWS`` squared exists at a time.

Rows without a vector take no part; vectors of different length are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_ROWS = 2048
MIN_BLOCK_ROWS = 512
MAX_TASKS = 20_000
# Pieces of BLOCK_ROWS that a large block has; tables are cut into SPREAD
# blocks for parallel work before blocks grow.
HELD_BLOCKS = 16
SPREAD = 16

# Similarities are compared as integers of this many per unit, so that equal
# pairs stay equal whatever the shape of the product they came from.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Block:
    """One side of a tile: ids, labels (or None), unit vectors, and the Arrow table."""

    ids: np.ndarray
    labels: np.ndarray | None
    unit: np.ndarray
    table: pa.Table

    def take(self, rows: np.ndarray) -> Block:
        labels = None if self.labels is None else self.labels[rows]
        return Block(self.ids[rows], labels, self.unit[rows], self.table.take(pa.array(rows)))

    def column(self, name: str) -> np.ndarray:
        return _plain(self.table.column(name))


TileFn = Callable[[Block, Block, bool], "dict[str, object] | None"]


class TileReduce:
    """A tile function that goes on from piece to piece: a block's piece is started once, meets every piece of the
    other block, and returns its columns at the end, so that a tile holds what it will return and no more."""

    def start(self, left: Block) -> object:
        raise NotImplementedError

    def add(self, state, right: Block) -> None:
        raise NotImplementedError

    def result(self, state) -> dict[str, object]:
        raise NotImplementedError


def _plain(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def unit_vectors(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a float64 matrix of unit rows; a zero vector stays zero."""
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    column = column.combine_chunks()
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors must be present and of one length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(rows, -1)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def scaled_similarities(left: Block, right: Block) -> np.ndarray:
    """Cosine of every row of ``left`` with every row of ``right``, in units of ``SCALE`` before rounding."""
    values = left.unit @ right.unit.T
    values *= SCALE
    return values


def similarity_codes(left: Block, right: Block) -> np.ndarray:
    """The same, as integers."""
    values = scaled_similarities(left, right)
    return np.rint(values, out=values).astype(np.int64)


def same_cells(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the cells where the ids of both sides are equal, found by a sort."""
    if any(x.dtype == object and any(v is None for v in x) for x in (left, right)):
        return np.nonzero(left[:, None] == right[None, :])
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    first = np.searchsorted(ordered, left, "left")
    n = np.searchsorted(ordered, left, "right") - first
    rows = np.repeat(np.arange(len(left)), n)
    cols = order[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    equal = left[rows] == right[cols]
    return rows[equal], cols[equal]


def unit_codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Cosine of each row of one vector column with the same row of another, as integers."""
    a, b = unit_vectors(left), unit_vectors(right)
    return np.rint(np.einsum("ij,ij->i", a, b) * SCALE).astype(np.int64)


def label_codes(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as integers, -1 for no label."""
    codes, _ = pd.factorize(np.concatenate([left.labels, right.labels]))
    return codes[: len(left.ids)], codes[len(left.ids):]


def _block(table: pa.Table, vector: str | None) -> Block:
    names = table.column_names
    unit = unit_vectors(table.column(vector)) if vector else np.zeros((table.num_rows, 0))
    labels = None
    if "label" in names:
        labels = table.column("label").to_pandas().to_numpy()
    ident = table.column("id")
    ids = np.arange(table.num_rows) if pa.types.is_struct(ident.type) else _plain(ident)
    return Block(ids, labels, unit, table)


def _arrow(parts: list[dict[str, object]], schema: pa.Schema) -> pa.Table:
    tables = [
        pa.table([pa.array(part[f.name], type=f.type) for f in schema], schema=schema)
        for part in parts if part is not None
    ]
    return pa.concat_tables(tables) if tables else schema.empty_table()


def block_count(rows: int) -> int:
    """Blocks of a table: a few even for a small one, then ``SPREAD``, then as many as hold all rows."""
    fine = max(math.ceil(rows / BLOCK_ROWS), min(4, math.ceil(rows / MIN_BLOCK_ROWS)), 1)
    return max(min(fine, SPREAD), math.ceil(rows / (HELD_BLOCKS * BLOCK_ROWS)))


def _pieces(table: pa.Table, vector: str | None) -> Iterator[Block]:
    for at in range(0, table.num_rows, BLOCK_ROWS):
        yield _block(table.slice(at, BLOCK_ROWS), vector)


def _meet(
    fn: TileFn | TileReduce, a: pa.Table, b: pa.Table, vector: str | None, diagonal: bool,
) -> list[dict[str, object] | None]:
    """All pieces of one block with all of another; the first block is held, the second goes by."""
    held = list(_pieces(a, vector))
    if isinstance(fn, TileReduce):
        states = [fn.start(left) for left in held]
        for right in _pieces(b, vector):
            for state in states:
                fn.add(state, right)
        return [fn.result(state) for state in states]
    return [fn(left, right, diagonal) for right in _pieces(b, vector) for left in held]


def _with_vectors(df: DataFrame, vector: str | None) -> DataFrame:
    return df if vector is None else df.filter(F.col(vector).isNotNull())


def block_of(ident: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")


def _spread(df: DataFrame, column: str, first, last) -> DataFrame:
    return df.withColumn(column, F.explode(F.sequence(first, last)))


def _fresh(df: DataFrame) -> DataFrame:
    """Same columns under new identities, so that a table can be paired with itself."""
    return df.select(*[F.col(k).alias(k) for k in df.columns])


def partition_of(n: int) -> Column:
    """Partition of a tile number, which may exceed 32 bits."""
    return F.pmod(F.col("_t"), F.lit(n)).cast("int")


def _run(left: DataFrame, right: DataFrame, tasks: int, fn: Callable, schema: T.StructType) -> DataFrame:
    """Cogroup two sides that carry the tile number ``_t``, one shuffle per side."""
    n = max(1, min(tasks, MAX_TASKS))
    right = _fresh(right)
    return (
        left.repartitionById(n, partition_of(n)).groupBy("_t")
        .cogroup(right.repartitionById(n, partition_of(n)).groupBy("_t"))
        .applyInArrow(fn, schema)
    )


def cogroup_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], tasks: int, fn: TileFn | TileReduce, schema: str,
    vector: str | None = "embedding",
) -> DataFrame:
    """Tiles given by ``keys`` on both sides, spread over up to ``tasks`` tasks."""
    schema_type = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema_type)
    n = max(1, min(tasks, MAX_TASKS))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return arrow.empty_table()
        return _arrow(_meet(fn, a, b, vector, False), arrow)

    def side(df: DataFrame):
        return df.repartition(n, *keys).groupBy(*keys)

    return side(left).cogroup(side(_fresh(right))).applyInArrow(run, schema_type)


def placed_join(
    left: DataFrame, right: DataFrame, key: str, fn: TileFn | TileReduce, schema: str, vector: str | None = "embedding",
) -> DataFrame:
    """The rows of both sides with the same ``key`` as a tile each; a side that is stored in buckets of the key stays there."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _arrow(_meet(fn, a, b, vector, False), arrow)

    return left.groupBy(key).cogroup(_fresh(right).groupBy(key)).applyInArrow(run, T._parse_datatype_string(schema))


def tile_join(
    probes: DataFrame, gallery: DataFrame, fn: TileFn | TileReduce, schema: str, *,
    blocks: tuple[int, int], vector: str | None = "embedding",
) -> DataFrame:
    """Every probe block against every gallery block.

    Both tables need ``id``; ``fn(probe_block, gallery_block, False)`` returns
    columns of ``schema``.
    """
    pb, gb = blocks
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(p: pa.Table, g: pa.Table) -> pa.Table:
        return _arrow(_meet(fn, p, g, vector, False), arrow)

    probes, gallery = _with_vectors(probes, vector), _with_vectors(gallery, vector)
    left = _spread(probes.withColumn("_i", block_of(F.col("id"), pb)), "_j", F.lit(0), F.lit(gb - 1))
    right = _spread(gallery.withColumn("_j", block_of(F.col("id"), gb)), "_i", F.lit(0), F.lit(pb - 1))
    number = (F.col("_i").cast("long") * gb + F.col("_j")).alias("_t")
    return _run(
        left.select(*probes.columns, number), right.select(*gallery.columns, number),
        pb * gb, run, T._parse_datatype_string(schema),
    )


def pair_tiles(
    items: DataFrame, fn: TileFn, schema: str, *, blocks: int, vector: str | None = "embedding",
) -> DataFrame:
    """Every unordered pair of one table once.

    Off the diagonal all pairs of a tile count; on it (``diagonal=True``) ``fn``
    keeps those with left id < right id.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    on_diagonal = {j * (j + 1) // 2 + j for j in range(blocks)}

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _arrow(_meet(fn, a, b, vector, key[0].as_py() in on_diagonal), arrow)

    def triangle(i: Column, j: Column) -> Column:
        return (F.shiftright(j.cast("long") * (j + 1), 1) + i).alias("_t")

    items = _with_vectors(items, vector)
    based = items.withColumn("_b", block_of(F.col("id"), blocks))
    left = _spread(based, "_j", F.col("_b"), F.lit(blocks - 1))
    right = _spread(based, "_i", F.lit(0), F.col("_b"))
    return _run(
        left.select(*items.columns, triangle(F.col("_b"), F.col("_j"))),
        right.select(*items.columns, triangle(F.col("_i"), F.col("_b"))),
        blocks * (blocks + 1) // 2, run, T._parse_datatype_string(schema),
    )


def group_tiles(
    items: DataFrame, fn: TileFn, schema: str, *, rows: int, vector: str | None = "embedding",
) -> DataFrame:
    """Unordered pairs within each label once.

    Labels that fit a block share tiles by hash; a label with more rows is
    salted by id into blocks of its own, and those are paired like a table. So a
    label that holds a third of all rows is spread over many tasks. ``rows`` is
    the size of ``items``; rows without a label take no part.
    """
    schema_type = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema_type)
    shared = max(block_count(rows), math.ceil(rows / BLOCK_ROWS))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0:
            return arrow.empty_table()
        left = _block(a, vector)
        if a.column("_hot")[0].as_py():
            if b.num_rows == 0:
                return arrow.empty_table()
            diagonal = a.column("_i")[0].as_py() == a.column("_j")[0].as_py()
            return _arrow([fn(left, _block(b, vector), diagonal)], arrow)
        # Labels that share a tile come on the left side only: one pass per label.
        codes, _ = pd.factorize(left.labels)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        parts = []
        for members in np.split(order, cuts):
            if len(members) > 1:
                one = left.take(members)
                parts.append(fn(one, one, True))
        return _arrow(parts, arrow)

    labelled = _with_vectors(items, vector).filter(F.col("label").isNotNull())
    hot = (
        labelled.groupBy("label").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK_ROWS)
        .select("label", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_k"))
    )
    marked = labelled.join(hot, "label", "left").select(
        *items.columns,
        F.col("_k").isNotNull().alias("_hot"),
        F.coalesce(F.col("_k"), F.lit(1)).alias("_k"),
    )
    sub = F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")
    marked = marked.withColumn("_b", F.when(F.col("_hot"), sub).otherwise(F.lit(0)))
    cell = F.when(F.col("_hot"), F.xxhash64("label")).otherwise(
        F.pmod(F.xxhash64("label"), F.lit(shared)))
    left = _spread(marked, "_j", F.col("_b"), F.col("_k") - 1).withColumn("_i", F.col("_b"))
    right = _spread(marked.filter("_hot"), "_i", F.lit(0), F.col("_b")).withColumn("_j", F.col("_b"))
    keys = ["_hot", "_cell", "_i", "_j"]
    n = max(1, min(shared * 2, MAX_TASKS))

    def side(df: DataFrame):
        tiles = df.withColumn("_cell", cell).select(*items.columns, *keys)
        return tiles.repartition(n, *keys).groupBy(*keys)

    return side(left).cogroup(side(_fresh(right))).applyInArrow(run, schema_type)


def keep_upper(mask: np.ndarray | None, left: Block, right: Block, diagonal: bool) -> np.ndarray:
    """Cells of a tile that stand for an unordered pair."""
    shape = (len(left.ids), len(right.ids))
    keep = left.ids[:, None] < right.ids[None, :] if diagonal else np.ones(shape, dtype=bool)
    return keep if mask is None else keep & mask


def streamed_tiles(
    sides: list[DataFrame], tasks: int, fn: Callable, schema: str, order: tuple[str, ...] = (),
) -> DataFrame:
    """Tiles whose sides pass through a task one after the other, none of them held as a whole by Spark;
    a side's rows come along ``order``.

    Each side carries the tile number ``_t`` and otherwise the same columns.
    ``fn(parts)`` gets the parts of one tile as ``(side, piece)``, sides in
    order and pieces of up to ``BLOCK_ROWS`` rows, and yields dicts of ``schema``.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    n = max(1, min(tasks, MAX_TASKS))
    rows = reduce(DataFrame.unionByName, [df.withColumn("_side", F.lit(i)) for i, df in enumerate(sides)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, side = (np.asarray(batch.column(k)) for k in ("_t", "_side"))
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(side) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                for at in range(low, high, BLOCK_ROWS):
                    part = batch.slice(at, min(BLOCK_ROWS, high - at))
                    yield int(tile[low]), int(side[low]), pa.Table.from_batches([part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(pieces(batches), key=lambda x: x[0]):
            for found in fn((side, piece) for _, side, piece in parts):
                yield from _arrow([found], arrow).to_batches()

    dealt = rows.repartitionById(n, partition_of(n)).sortWithinPartitions("_t", "_side", *order)
    return dealt.mapInArrow(run, schema)
