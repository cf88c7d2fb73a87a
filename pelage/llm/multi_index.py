"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into two halves with a codebook each; the product of the
two books is a grid of cells. Every vector lives in one cell and visits others:
the multi-sequence traversal takes half cells in the order of how near a
partner in them could be (the distance to the border between two centres is a
lower bound) and goes on until the bounds of both halves together pass a
radius. With ``target_recall=1`` that is the radius of the threshold and no
link can be missed, but in high dimensions hardly a cell is left out. A lower
target takes the radius that this share of partners needs which lie exactly at
the threshold, in random directions from the vectors of the fitting sample:
closer partners need less, so the recall over all links is higher than the
target. Every visit is then verified by the exact cosine.

Equal vectors of a label are one class with a weight, so copies cost nothing.
The cells of one row of the grid (one centre of the first half) and label lie
together, cut into blocks of bounded size: a vector is sent once to a row that
it visits, with the cells it reaches there. A block is held while its visitors
stream past, and only spanning edges leave it.

Cases: a vector that is NULL, zero, or holds a NULL or a non-finite number, and
one whose label or id is NULL links with nothing (component is its own id);
vectors of different length do not link; repeated rows count once and each
comes back; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.components import components
from pelage.llm.storage import stored

c = F.col

# Vectors that the codebooks are fitted on, drawn by a hash of the id.
FIT_ROWS = 8192
BLOCK = 4096
_VISITS = 512


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Rows as unit vectors in double precision, padded with zeros."""
    sizes = np.array(pa.compute.list_value_length(column).fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()))
    if len(sizes) and (sizes == dims).all():
        out = flat.reshape(len(sizes), dims).copy()
    else:
        out = np.zeros((len(sizes), dims))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


class Index:
    """Two codebooks and the search radius."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, target_recall: float):
        self.dims = sample.shape[1]
        self.half = -(-self.dims // 2)
        self.books = [self._fit(part, size) for part in (sample[:, :self.half], sample[:, self.half:])]
        # |x - y|^2 = 2 - 2 cos for unit vectors; a little room for rounding.
        self.radius = 2 - 2 * threshold + 1e-9
        if target_recall < 1:
            random = np.random.default_rng(7).normal(size=sample.shape)
            random -= (random * sample).sum(1, keepdims=True) * sample
            random /= np.maximum(np.linalg.norm(random, axis=1, keepdims=True), 1e-12)
            partners = threshold * sample + np.sqrt(1 - threshold ** 2) * random
            rows = np.arange(len(sample))
            need = sum(b[rows, h] for b, h in zip(self.bounds(sample), self.home(partners)))
            self.radius = min(self.radius, float(np.quantile(need, target_recall)) + 1e-9)

    @staticmethod
    def _fit(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
        centres = np.unique(points, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(size, len(centres))).astype(int)]
        for _ in range(rounds):
            near = (((centres ** 2).sum(1)[None, :] - 2 * points @ centres.T)).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            n = np.bincount(near, minlength=len(centres))
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        return np.unique(centres, axis=0)

    def _distances(self, units: np.ndarray) -> list[np.ndarray]:
        parts = units[:, :self.half], units[:, self.half:]
        return [(p ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * p @ b.T for p, b in zip(parts, self.books)]

    def home(self, units: np.ndarray) -> list[np.ndarray]:
        return [d.argmin(1) for d in self._distances(units)]

    def bounds(self, units: np.ndarray) -> list[np.ndarray]:
        """Per half: least squared distance that a point of each centre's cell can have."""
        result = []
        for d, book in zip(self._distances(units), self.books):
            home = d.argmin(1)
            gap = np.sqrt(np.maximum(((book[:, None] - book[None, :]) ** 2).sum(2), 0))[home]
            border = (d - d.min(1)[:, None]) / np.where(gap > 0, 2 * gap, 1)
            result.append(np.maximum(border - 1e-9, 0) ** 2)
        return result

    def visits(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each vector the cells it has to look into, nearest first.

        Multi-sequence traversal: in both halves the centres are sorted by
        bound; for each step along the first the second is followed only while
        the sum stays within the radius, and the union is put in order.
        """
        first, second = self.bounds(units)
        width = len(self.books[1])
        one, two = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        for row in range(len(units)):
            a, b = first[row, one[row]], second[row, two[row]]
            reach = np.searchsorted(b, self.radius - a, "right")
            i = np.repeat(np.arange(len(a)), reach)
            j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
            order = np.argsort(a[i] + b[j], kind="stable")
            yield row, (one[row, i] * width + two[row, j])[order]

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.home(units)
        return a * len(self.books[1]) + b


def fit(vectors: DataFrame, threshold: float, target_recall: float, size: int | None = None) -> Index | None:
    """Codebooks from a sample of at most ``FIT_ROWS`` classes; None for an empty table."""
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    sample = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    units = _units(sample.column("embedding").combine_chunks(), dims)
    return Index(units, size or int(np.clip(round(n ** 0.25), 4, 256)), threshold, target_recall)


def _place(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            first, second = index.home(_units(part.column("embedding"), index.dims))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "label": part.column("label"), "weight": part.column("weight"),
                "embedding": part.column("embedding"),
                "first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32())})


def _visit(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """One row for each row of the grid that a vector visits, with the cells of that row."""
    width = len(index.books[1])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            owners, firsts, seconds = [], [], []
            for owner, cells in index.visits(_units(part.column("embedding"), index.dims)):
                cells = np.sort(cells)
                first, start = np.unique(cells // width, return_index=True)
                owners.append(np.full(len(first), owner))
                firsts.append(first)
                seconds += np.split((cells % width).astype(np.int32), start[1:])
            rows = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id").take(rows), "label": part.column("label").take(rows),
                "embedding": part.column("embedding").take(rows),
                "first": pa.array(np.concatenate(firsts), pa.int32()), "seconds": pa.array(seconds, pa.list_(pa.int32()))})


class _Held:
    """Members of one block, and how links tie them together."""

    def __init__(self, rows: list[pa.RecordBatch], dims: int):
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        self.ids = np.asarray(table.column("id"))
        self.weights = np.asarray(table.column("weight"))
        self.sizes = np.asarray(pa.compute.list_value_length(table.column("embedding")))
        self.units = _units(table.column("embedding"), dims)
        self.second = np.asarray(table.column("seconds").flatten())
        self.root = np.arange(len(self.ids))
        self.linked = np.zeros(len(self.ids), bool)

    def meet(self, visitors: pa.RecordBatch, dims: int, threshold: float) -> pa.RecordBatch:
        """Link weights of the visitors, and for each linked one an edge to a member."""
        ids = np.asarray(visitors.column("id"))
        sizes = np.asarray(pa.compute.list_value_length(visitors.column("embedding")))
        link = _units(visitors.column("embedding"), dims) @ self.units.T >= threshold
        link &= (ids[:, None] != self.ids[None, :]) & (sizes[:, None] == self.sizes[None, :])
        # Only the cells of this row of the grid that the traversal reached.
        counts = np.asarray(pa.compute.list_value_length(visitors.column("seconds")))
        cells = np.asarray(visitors.column("seconds").flatten())
        visited = np.zeros((len(ids), max(self.second.max(initial=0), cells.max(initial=0)) + 1), bool)
        visited[np.repeat(np.arange(len(ids)), counts), cells] = True
        link &= visited[:, self.second]
        hit = np.flatnonzero(link.any(1))
        target = np.zeros(len(hit), np.int64)
        for k, row in enumerate(hit):
            mates = np.flatnonzero(link[row])
            roots = np.unique(self.root[mates])
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
            self.linked[mates] = True
            target[k] = self.ids[mates[0]]
        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids[hit]), "links": pa.array(link[hit] @ self.weights, pa.int64()), "mate": pa.array(target)})

    def edges(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.linked & (self.root != np.arange(len(self.root))))
        return pa.RecordBatch.from_pydict({
            "id": pa.array(self.ids[at]), "links": pa.array(np.zeros(len(at), np.int64)),
            "mate": pa.array(self.ids[self.root[at]])})


def _meet(batches: Iterator[pa.RecordBatch], dims: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, members before visitors."""
    unit, rows, held = None, [], None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("unit", "role")], 1)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        for low, high in zip(cuts, np.r_[cuts[1:], len(keys)]):
            this, role = keys[low]
            part = batch.slice(int(low), int(high - low))
            if this != unit:
                if held is not None:
                    yield held.edges()
                unit, rows, held = this, [], None
            if role == 0:
                rows.append(part)
                continue
            if held is None:
                if not rows:
                    continue
                held, rows = _Held(rows, dims), []
            for at in range(0, part.num_rows, _VISITS):
                yield held.meet(part.slice(at, _VISITS), dims, threshold)
    if held is not None:
        yield held.edges()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                    threshold: float = 0.93, target_recall: float = 0.999, size: int | None = None) -> DataFrame:
    """``id, n_links, component`` for every row: vectors of its label with cosine >= threshold."""
    # Single precision travels as it is; tasks compute in double.
    vector_type = vectors.schema[vector_col].dataType.simpleString()
    vector_type = vector_type if vector_type == "array<float>" else "array<double>"
    rows = vectors.select(
        c(id_col).cast("long").alias("id"), c(label_col).alias("label"),
        c(vector_col).cast(vector_type).alias("embedding"))
    usable = (c("id").isNotNull() & c("label").isNotNull() & c("embedding").isNotNull()
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    good = rows.where(usable).distinct()
    classes = stored(good.groupBy("label", "embedding").agg(
        F.min("id").alias("id"), F.countDistinct("id").alias("weight")), "index-classes")
    index = fit(classes, threshold, target_recall, size)
    if index is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), c("id").alias("component"))
    kind = classes.schema["label"].dataType.simpleString()
    members = stored(classes.select("id", "label", "weight", "embedding").mapInArrow(
        lambda b: _place(b, index), f"id long, label {kind}, weight long, embedding {vector_type}, first int, second int"), "index-members")
    sizes = members.groupBy("label", "first").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "first", F.ceil(c("n") / BLOCK).cast("int").alias("blocks"))
    visitors = classes.select("id", "label", "embedding").mapInArrow(
        lambda b: _visit(b, index), f"id long, label {kind}, embedding {vector_type}, first int, seconds array<int>")
    inside = members.join(sizes, ["label", "first"]).select(
        "label", "first", F.pmod(F.xxhash64("id"), c("blocks")).cast("int").alias("block"), F.lit(0).alias("role"),
        "id", "weight", "embedding", F.array("second").alias("seconds"))
    # A vector goes once to each block of the rows of the grid that it visits; empty ones have no size and drop it.
    coming = visitors.join(sizes, ["label", "first"]).select(
        "label", "first", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("block"), F.lit(1).alias("role"),
        "id", F.lit(1).cast("long").alias("weight"), "embedding", "seconds")
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = inside.union(coming).withColumn("unit", F.xxhash64("label", "first", "block"))
    met = stored(units.repartition(width, "unit").sortWithinPartitions("unit", "role").select(
        "unit", "role", "id", "weight", "embedding", "seconds").mapInArrow(
            lambda b: _meet(b, index.dims, threshold), "id long, links long, mate long"), "index-met")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(met.select(c("id").alias("a"), c("mate").alias("b")), "index")
    own = (classes.join(links, "id", "left").join(groups, "id", "left")
           .select("label", "embedding", (F.coalesce("links", F.lit(0)) + c("weight") - 1).alias("n_links"),
                   F.coalesce("component", "id").alias("component")))
    keyed = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    found = keyed.where("usable").join(own, ["label", "embedding"]).select("id", "n_links", "component")
    rest = keyed.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), c("id").alias("component"))
    return found.union(rest)
