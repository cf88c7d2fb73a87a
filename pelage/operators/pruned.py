"""Top-k search that skips what cannot matter.

Gallery vectors are put into a tree of two levels: the cell of the nearest
pivot, and in it the part of the nearest sub-pivot. A probe first searches its
home cell; its k-th best similarity there and the triangle inequality on the
sphere then rule out first whole cells and then parts of the others, by the
largest angle that any of their vectors has to its pivot. A probe is sent once
to each cell that is left, with the parts to look at. The result is the exact
top-k. Whether the tree pays is decided before any search, on a bounded sample
of the gallery, one half of which makes a tree for the other: where the bounds
would let too much of it pass, or send a probe to too many cells, the plain tile
search answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.functions.ordering import random_key
from pelage.operators import tiles
from pelage.operators.retrieval import _Nearest, _type, best_of_tiles, missing_last, nearest_in_tile, topk_neighbors
from pelage.operators.tiles import SCALE, SPREAD, Block, TileReduce, cogroup_blocks, same_cells, unit_vectors
from pelage.session import materialize

c = F.col

# Pivots, and sub-pivots of each, are collected and shipped with the tasks: at most this many vectors.
MAX_PIVOTS, PARTS = 512, 16
# Vectors that the decision is made on, at least; of these so many are asked.
SAMPLE, ASKED = 1024, 256
# Share of the sample that the bounds may let pass for the tree to pay, and cells that a probe may be sent to:
# the plain search sends a vector to so many tiles at least.
WORTHWHILE, WORTHWHILE_VISITS = 0.25, SPREAD
# Cell of vectors without length: their similarity to anything is 0.
_ZERO_CELL = -1
# Covers the rounding of angles near 0.
_ANGLE_MARGIN = 2e-7
# Probes whose visits a task works out together, and visits that it hands on at once.
PROBES_AT_ONCE, VISITS_AT_ONCE = 512, 8_192


def _cells(part: np.ndarray) -> np.ndarray:
    return np.where(part == _ZERO_CELL, _ZERO_CELL, part // PARTS)


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Numbers of ``n`` vectors, each the farthest from those before it: tight groups get a pivot each."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < n:
        nearest[chosen[-1]] = np.inf
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return np.array(chosen)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


class Tree:
    """Pivots, their sub-pivots, and how far their vectors reach."""

    def __init__(self, sample: np.ndarray, rows: int):
        sample = sample[sample.any(axis=1)]
        n = max(1, min(MAX_PIVOTS, math.isqrt(rows), len(sample)))
        first = _far_apart(sample, n) if len(sample) else np.zeros(0, int)
        self.pivots, rest = sample[first], np.delete(sample, first, axis=0)
        near = _angles(rest, self.pivots).argmin(axis=1) if len(rest) else np.zeros(0, int)
        self.parts = [np.concatenate([p[None], rest[near == i][:PARTS - 1]]) for i, p in enumerate(self.pivots)]
        self.reach = np.zeros(len(self.pivots))
        self.part_reach = [np.zeros(len(x)) for x in self.parts]

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(part number, angle to the pivot, angle to the sub-pivot) of each vector; the cell is the number by ``PARTS``."""
        angle = _angles(unit, self.pivots)
        cell = angle.argmin(axis=1)
        outer, inner, part = angle[np.arange(len(unit)), cell], np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for i in np.unique(cell):
            rows = np.flatnonzero(cell == i)
            own = _angles(unit[rows], self.parts[i])
            part[rows] = own.argmin(axis=1)
            inner[rows] = own.min(axis=1)
        number = cell * PARTS + part
        number[~unit.any(axis=1)] = _ZERO_CELL
        return number, outer, inner

    def reaching(self, number: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> None:
        """Takes over the largest angles of some vectors."""
        for x, a, b in zip(number.tolist(), outer.tolist(), inner.tolist()):
            if x != _ZERO_CELL:
                cell, part = divmod(x, PARTS)
                self.reach[cell] = max(self.reach[cell], a)
                self.part_reach[cell][part] = max(self.part_reach[cell][part], b)

    def visits(self, unit: np.ndarray, kth: np.ndarray, home: np.ndarray, filled: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) that may hold something as good as ``kth`` (in codes), outside each row's home cell."""
        def bound(angle: np.ndarray, reach: np.ndarray) -> np.ndarray:
            nearest = np.maximum(0.0, angle - reach - _ANGLE_MARGIN)
            return np.ceil(np.cos(nearest) * SCALE).astype(np.int64) + 1

        empty = ~unit.any(axis=1)
        upper = bound(_angles(unit, self.pivots), self.reach)
        upper[empty] = 0
        rows, parts = [], []
        for cell in np.flatnonzero((upper >= kth[:, None]).any(axis=0)):
            asked = np.flatnonzero((upper[:, cell] >= kth) & (home != cell))
            if not len(asked):
                continue
            fine = bound(_angles(unit[asked], self.parts[cell]), self.part_reach[cell])
            fine[empty[asked]] = 0
            r, part = np.nonzero(fine >= kth[asked][:, None])
            rows.append(asked[r])
            parts.append(cell * PARTS + part)
        if _ZERO_CELL in filled:
            asked = np.flatnonzero((kth <= 0) & (home != _ZERO_CELL))
            rows.append(asked)
            parts.append(np.full(len(asked), _ZERO_CELL))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, part = np.concatenate(rows), np.concatenate(parts)
        keep = np.isin(part, np.array(sorted(filled)))
        return row[keep], part[keep]


def _sample(gallery: DataFrame, rows: int, seed: int) -> np.ndarray:
    n = max(SAMPLE, 2 * min(MAX_PIVOTS, math.isqrt(max(rows, 1))) * (1 + PARTS))
    drawn = gallery.orderBy(random_key(seed, "id"), "id").limit(n).select("embedding").collect()
    vectors = np.array([r[0] for r in drawn], dtype=np.float64)
    if not len(vectors):
        return np.zeros((0, 1))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms > 0, norms, 1.0)
    return unit[np.isfinite(unit).all(axis=1)]


def expected_work(sample: np.ndarray, rows: int, k: int) -> tuple[float, float]:
    """(share of the gallery that the bounds let pass, cells that a probe is sent to), measured on the sample.

    Half of it makes the tree. The other half, of which no vector is a pivot or
    sub-pivot, lies in it, and some of that half ask. As in the search, a probe's
    k-th best is that of its home cell; the k-th best of the whole gallery is
    about the (k x sample / gallery)-th of the sample.
    """
    tree, rest = Tree(sample[:len(sample) // 2], rows), sample[len(sample) // 2:]
    asked = rest[:ASKED]
    if not len(tree.pivots):
        return 1.0, math.inf
    placed = tree.place(rest)
    tree.reaching(*placed)
    cells = _cells(placed[0])
    home = cells[:len(asked)]
    at_home = home[:, None] == cells[None, :]
    codes = np.where(at_home, np.rint(asked @ rest.T * SCALE).astype(np.int64), -2 * SCALE)
    np.fill_diagonal(codes, -2 * SCALE)
    place = min(codes.shape[1], max(1, math.ceil(k * len(rest) / max(rows, 1))))
    kth = np.partition(codes, codes.shape[1] - place, axis=1)[:, codes.shape[1] - place]
    numbers, counts = np.unique(placed[0], return_counts=True)
    size = dict(zip(numbers.tolist(), counts.tolist()))
    asking, parts = tree.visits(asked, kth, home, set(size))
    passing = at_home.sum() + sum(size[p] for p in parts.tolist())
    return float(passing / (len(asked) * len(rest))), len(by_cell(asking, parts)[0]) / len(asked)


def passing_share(sample: np.ndarray, rows: int, k: int) -> float:
    """Share of the gallery that the bounds let pass, measured on the sample."""
    return expected_work(sample, rows, k)[0]


def by_cell(row: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, set of the cell's parts as bits) of visits given part by part."""
    cell = _cells(part)
    bit = np.where(part == _ZERO_CELL, (1 << PARTS) - 1, 1 << (part % PARTS))
    order = np.lexsort((cell, row))
    row, cell, bit = row[order], cell[order], bit[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])][:len(row)])
    return row[head], cell[head], np.bitwise_or.reduceat(bit, head) if len(head) else bit


def _with_cells(df: DataFrame, tree: Tree) -> DataFrame:
    """Adds the part of each vector and its angles."""
    id_type, vector_type = (_type(df, k) for k in ("id", "embedding"))

    def assign(batches):
        for batch in batches:
            unit = unit_vectors(pa.chunked_array([batch.column("embedding")]))
            # A vector with a component that is no number is like nothing.
            known = np.isfinite(unit).all(axis=1)
            if not known.any():
                continue
            unit, batch = unit[known], batch.filter(pa.array(known))
            number, outer, inner = tree.place(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("embedding"), pa.array(number, pa.int32()), pa.array(outer), pa.array(inner)],
                ["id", "embedding", "part", "outer", "inner"])

    return df.filter(c("embedding").isNotNull()).select("id", "embedding").mapInArrow(
        assign, f"id {id_type}, embedding {vector_type}, part int, outer double, inner double")


class _Visiting(_Nearest):
    """Each probe's ``k`` best of those parts of a cell that it names, no worse than ``kth``."""

    def start(self, left: Block):
        _, best = super().start(left)
        best.floor = left.column("kth").astype(np.float64)
        return left, best

    def add(self, state, right: Block) -> None:
        left, best = state
        named, part = left.column("parts"), right.column("part") % PARTS
        values = np.full((len(left.ids), len(right.ids)), -np.inf)
        for i in np.unique(part).tolist():
            rows, cols = np.flatnonzero(named >> i & 1), np.flatnonzero(part == i)
            if len(rows):
                values[np.ix_(rows, cols)] = left.unit[rows] @ right.unit[cols].T * SCALE
        values = missing_last(values, left, right)
        values[same_cells(left.ids, right.ids)] = -np.inf
        best.add(values, right.ids)


def _search(visits: DataFrame, gallery: DataFrame, cells: dict[int, int], best: TileReduce, schema: str) -> DataFrame:
    """Per visit (probe, cell) the k best of the cell; both sides cut to blocks."""
    spark = visits.sparkSession
    load = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    size = tiles.BLOCK_ROWS
    rows = [(cell, -(-cells[cell] // size), -(-n // size)) for cell, n in load.items() if cell in cells]
    plan = F.broadcast(spark.createDataFrame(rows, "cell int, subs int, probe_blocks int"))  # one row per cell

    def part(blocks: str):
        return F.pmod(F.xxhash64("id"), c(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), c(blocks) - 1))

    left = visits.join(plan, "cell").withColumn("_p", part("probe_blocks")).withColumn("_s", every("subs"))
    right = gallery.join(plan, "cell").withColumn("_s", part("subs")).withColumn("_p", every("probe_blocks"))
    keys = ["_s", "_p"]
    return cogroup_blocks(
        left.select(*visits.columns, *keys), right.select(*gallery.columns, *keys), ["cell", *keys],
        max(1, sum(s * p for _, s, p in rows)), best, schema)


def topk_neighbors_pruned(probes: DataFrame, k: int = 5, gallery: DataFrame | None = None,
                          seed: int = 42) -> DataFrame:
    """Same rows as ``topk_neighbors``: ``probe_id, rank, gallery_id, similarity``."""
    own = gallery is None
    known = (probes if own else gallery).select("id", "embedding").filter(c("embedding").isNotNull())
    rows = known.count()
    sample = _sample(known, rows, seed)
    share, visits = expected_work(sample, rows, k)
    if share > WORTHWHILE or visits > WORTHWHILE_VISITS:
        return topk_neighbors(probes.select("id", "embedding"), k, None if own else known)
    return by_tree(probes, k, None if own else known, Tree(sample, rows))


def by_tree(probes: DataFrame, k: int, gallery: DataFrame | None, tree: Tree) -> DataFrame:
    """The search by cells and parts, whether it pays or not."""
    own = gallery is None
    placed = materialize(_with_cells(probes if own else gallery, tree), "pruned-gallery")
    asked = placed if own else materialize(_with_cells(probes, tree), "pruned-probes")
    # At most MAX_PIVOTS * PARTS + 1 rows.
    stats = placed.groupBy("part").agg(
        F.count("*").alias("n"), F.max("outer").alias("outer"), F.max("inner").alias("inner")).collect()
    parts = {r["part"]: r["n"] for r in stats}
    tree.reaching(*(np.array([r[x] for r in stats]) for x in ("part", "outer", "inner")))
    cells: dict[int, int] = {}
    for part, n in parts.items():
        cell = part if part == _ZERO_CELL else part // PARTS
        cells[cell] = cells.get(cell, 0) + n

    def celled(df: DataFrame) -> DataFrame:
        cell = F.when(c("part") == _ZERO_CELL, _ZERO_CELL).otherwise(F.floor(c("part") / PARTS)).cast("int")
        return df.select("id", "embedding", "part", cell.alias("cell"))

    asked, placed = celled(asked), celled(placed)
    best, schema = nearest_in_tile(asked, placed, k)
    home = materialize(
        best_of_tiles(_search(asked.drop("part"), placed.drop("part"), cells, best, schema), k).select(
            "probe_id", "gallery_id", F.round(c("similarity") * SCALE).cast("long").alias("code")), "pruned-home")
    reached = home.groupBy(c("probe_id").alias("id")).agg(F.count("*").alias("n_found"), F.min("code").alias("kth"))
    kth = F.when(c("n_found") >= k, c("kth")).otherwise(F.lit(-2 * SCALE))
    bounded = asked.join(reached, "id", "left").select(
        "id", "embedding", "cell", F.coalesce(kth, F.lit(-2 * SCALE)).cast("long").alias("kth"))
    filled = set(parts)
    id_type, vector_type = (_type(asked, x) for x in ("id", "embedding"))

    def candidates(batches):
        for batch in batches:
            # A probe may visit every cell, each time with its vector: few probes, and few visits, at a time.
            for at in range(0, batch.num_rows, PROBES_AT_ONCE):
                some = batch.slice(at, PROBES_AT_ONCE)
                unit = unit_vectors(pa.chunked_array([some.column("embedding")]))
                rows, cell, named = by_cell(
                    *tree.visits(unit, some.column("kth").to_numpy(), some.column("cell").to_numpy(), filled))
                for low in range(0, len(rows), VISITS_AT_ONCE):
                    part = slice(low, low + VISITS_AT_ONCE)
                    taken = some.take(pa.array(rows[part], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("id"), taken.column("embedding"), taken.column("kth"),
                         pa.array(cell[part], pa.int32()), pa.array(named[part], pa.int32())],
                        ["id", "embedding", "kth", "cell", "parts"])

    visits = materialize(
        bounded.mapInArrow(candidates, f"id {id_type}, embedding {vector_type}, kth long, cell int, parts int"), "pruned-visits")
    found = _search(visits, placed, cells, _Visiting(k, False), schema).select("probe_id", "gallery_id", "code")
    return best_of_tiles(home.unionByName(found), k)
