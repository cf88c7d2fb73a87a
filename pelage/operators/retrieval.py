"""Gallery search and retrieval metrics over an embedding table.

Items carry ``id``, ``embedding`` and, where a metric needs it, ``label``.
Ranking order everywhere: similarity descending (to nine decimals), then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelage.operators.prefix import positions, running
from pelage.operators.tiles import (
    BLOCK_ROWS, SCALE, SPREAD, Block, TileReduce, block_count, block_of, group_tiles, same_cells, scaled_similarities,
    similarity_codes, streamed_tiles, tile_join, unit_vectors,
)
from pelage.session import materialize

c = F.col

# Partner similarities that a task of average precision holds, 24 bytes each with their counts.
_LEVELS_PER_BLOCK = 4_000_000
# Gallery rows that pass one block of probes in one task.
_STRIPE_ROWS = 1 << 20
# Probes that pass a held gallery in one task, and similarities that it keeps at a time.
_PROBES_PER_TASK, _CODES_HELD = 16_384, 1 << 23


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _sides(probes: DataFrame, gallery: DataFrame | None) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    gallery = probes if gallery is None else gallery
    n_gallery = gallery.count()
    n_probes = n_gallery if gallery is probes else probes.count()
    return probes, gallery, (block_count(n_probes), block_count(n_gallery))


def _best_columns(codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place of the k best cells of each row (code desc, id asc)."""
    if codes.shape[1] > k:
        floor = np.partition(codes, codes.shape[1] - k, axis=1)[:, codes.shape[1] - k]
        rows, cols = np.nonzero(codes >= floor[:, None])
    else:
        rows, cols = (a.ravel() for a in np.indices(codes.shape))
    order = np.lexsort((ids[cols], -codes[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(codes.shape[0]))
    place = np.arange(len(rows)) - starts[rows]
    keep = place < k
    return rows[keep], cols[keep], place[keep]


_SELF = np.iinfo(np.int64).min


def missing_last(values: np.ndarray, left: Block, right: Block) -> np.ndarray:
    """Similarities to vectors that hold no numbers stand below all others, as the cells of an item with itself do."""
    if not (np.isfinite(left.unit).all() and np.isfinite(right.unit).all()):
        values[np.isnan(values)] = -np.inf
    return values


class Best:
    """The ``k`` best cells of each row seen so far (code desc, id asc), kept while pieces go by.

    Only cells that come near a row's ``k``-th best are rounded and sorted.
    """

    def __init__(self, rows: int, k: int):
        self.k = k
        self.floor = np.full(rows, -np.inf)
        self.row, self.code = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.taken: list[np.ndarray] | None = None

    def add(self, values: np.ndarray, *columns: np.ndarray) -> None:
        """Cells of one piece, ``-inf`` for none; the first of ``columns`` (one entry per column of cells) is the id."""
        floor, wide = self.floor, values.shape[1]
        if wide > self.k and (open_rows := np.flatnonzero(floor == -np.inf)).size:
            part = values if open_rows.size == len(values) else values[open_rows]
            kth = part.max(axis=1) if self.k == 1 else np.partition(part, wide - self.k, axis=1)[:, wide - self.k]
            floor = floor.copy()
            floor[open_rows] = kth
        # A unit below the floor: rounding moves a cell by half of one.
        rows, cols = np.nonzero(values >= (floor - 1.0)[:, None])
        found = values[rows, cols]
        real = found != -np.inf
        rows, cols, found = rows[real], cols[real], np.rint(found[real]).astype(np.int64)
        if not len(rows) and self.taken is not None:
            return
        given = [x[cols] for x in columns]
        row, code = np.concatenate([self.row, rows]), np.concatenate([self.code, found])
        taken = given if self.taken is None else [np.concatenate(x) for x in zip(self.taken, given)]
        order = np.lexsort((taken[0], -code, row))
        row = row[order]
        starts = np.searchsorted(row, np.arange(len(self.floor) + 1))
        keep = np.arange(len(row)) - starts[row] < self.k
        order = order[keep]
        self.row, self.code, self.taken = row[keep], code[order], [x[order] for x in taken]
        full = np.flatnonzero(np.diff(starts) >= self.k)
        ends = np.searchsorted(self.row, full, "right") - 1
        self.floor[full] = self.code[ends]


class _Nearest(TileReduce):
    def __init__(self, k: int, with_label: bool):
        self.k, self.with_label = k, with_label

    def start(self, left: Block):
        return left, Best(len(left.ids), self.k)

    def add(self, state, right: Block) -> None:
        left, best = state
        values = missing_last(scaled_similarities(left, right), left, right)
        values[same_cells(left.ids, right.ids)] = -np.inf
        best.add(values, right.ids, *([right.labels] if self.with_label else []))

    def result(self, state) -> dict:
        left, best = state
        ids, *labels = best.taken or [np.zeros(0, left.ids.dtype)] * (1 + self.with_label)
        out = {"probe_id": left.ids[best.row], "gallery_id": ids, "code": best.code}
        if self.with_label:
            out["is_match"] = np.asarray(left.labels[best.row] == labels[0], dtype=bool)
        return out


def nearest_in_tile(probes: DataFrame, gallery: DataFrame, k: int, with_label: bool = False):
    """Tile function that returns each probe's ``k`` best of a gallery block, and its schema."""
    schema = f"probe_id {_type(probes, 'id')}, gallery_id {_type(gallery, 'id')}, code long"
    return _Nearest(k, with_label), schema + (", is_match boolean" if with_label else "")


def best_of_tiles(partial: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what the tiles returned, ranked."""
    w = Window.partitionBy("probe_id").orderBy(c("code").desc(), c("gallery_id"))
    ranked = partial.withColumn("rank", F.row_number().over(w).cast("long")).filter(c("rank") <= k)
    cols = ["probe_id", "rank", "gallery_id", (c("code") / SCALE).alias("similarity")]
    return ranked.select(*cols, *[x for x in partial.columns if x == "is_match"])


def topk_neighbors(probes: DataFrame, k: int = 5, gallery: DataFrame | None = None) -> DataFrame:
    """The k most similar gallery items per probe, self excluded.

    Returns ``probe_id, rank, gallery_id, similarity`` (plus ``is_match`` when
    both sides carry ``label``). Each tile keeps its own k best, a window
    merges them.
    """
    with_label = "label" in probes.columns and (gallery is None or "label" in gallery.columns)
    names = ["id", "embedding"] + (["label"] if with_label else [])
    probes = probes.select(*names)
    gallery = None if gallery is None else gallery.select(*names)
    p, g, blocks = _sides(probes, gallery)
    best, schema = nearest_in_tile(p, g, k, with_label)
    return best_of_tiles(tile_join(p, g, best, schema, blocks=blocks), k)


def rank_gallery(probes: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Answer to "is there an animal, and which images are most like it?".

    Every probe appears: ``has_animal`` is false without an embedding, and the
    match columns are NULL when there is nothing to rank.
    """
    searchable = probes.filter(c("embedding").isNotNull())
    matches = topk_neighbors(
        searchable.select("id", "embedding"), k,
        gallery.filter(c("embedding").isNotNull()).select("id", "embedding"),
    )
    asked = probes.select(c("id").alias("probe_id"), c("embedding").isNotNull().alias("has_animal"))
    return asked.join(matches, "probe_id", "left")


def gallery_pairs(probes: DataFrame, gallery: DataFrame | None = None) -> DataFrame:
    """All probe x gallery similarities, self excluded, as one summary row per probe.

    ``probe_id, n_pairs, mean_similarity, min_similarity, max_similarity``; the
    pairs themselves stay in the tiles.
    """
    names = ["id", "embedding"]
    p, g, blocks = _sides(probes.select(*names), None if gallery is None else gallery.select(*names))
    id_type = _type(p, "id")

    def summary(left: Block, right: Block, _diagonal: bool) -> dict:
        sims = left.unit @ right.unit.T
        other = left.ids[:, None] != right.ids[None, :]
        n = other.sum(axis=1)
        rows = n > 0
        return {
            "probe_id": left.ids[rows], "n": n[rows],
            "total": np.where(other, sims, 0.0).sum(axis=1)[rows],
            "low": np.where(other, sims, np.inf).min(axis=1)[rows],
            "high": np.where(other, sims, -np.inf).max(axis=1)[rows],
        }

    schema = f"probe_id {id_type}, n long, total double, low double, high double"
    return tile_join(p, g, summary, schema, blocks=blocks).groupBy("probe_id").agg(
        F.sum("n").alias("n_pairs"),
        (F.sum("total") / F.sum("n")).alias("mean_similarity"),
        F.min("low").alias("min_similarity"),
        F.max("high").alias("max_similarity"),
    )


def best_same_identity(items: DataFrame, rows: int | None = None) -> DataFrame:
    """``id, best_code, best_id``: the most similar other item of the same label."""
    items = items.select("id", "label", "embedding")
    id_type = _type(items, "id")
    rows = items.count() if rows is None else rows

    def best(left: Block, right: Block, diagonal: bool) -> dict:
        codes = similarity_codes(left, right)
        if diagonal:
            codes[left.ids[:, None] == right.ids[None, :]] = _SELF
        r, cc, _ = _best_columns(codes, right.ids, 1)
        out = [(left.ids[r], codes[r, cc], right.ids[cc])]
        if not diagonal:
            r, cc, _ = _best_columns(codes.T, left.ids, 1)
            out.append((right.ids[r], codes[cc, r], left.ids[cc]))
        ids, best_codes, best_ids = (np.concatenate(x) for x in zip(*out))
        real = best_codes != _SELF
        return {"id": ids[real], "best_code": best_codes[real], "best_id": best_ids[real]}

    schema = f"id {id_type}, best_code long, best_id {id_type}"
    tiles = group_tiles(items, best, schema, rows=rows)
    first = F.min(F.struct((-c("best_code")).alias("neg"), "best_id")).alias("_f")
    return tiles.groupBy("id").agg(first).select(
        "id", (-c("_f.neg")).alias("best_code"), c("_f.best_id").alias("best_id"))


def identity_rank(gallery: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """1-based rank of the first same-identity gallery item of each probe.

    ``gallery`` (``id, label, embedding``) is everything with an embedding,
    labels may be NULL; ``probes`` are those of its items to rank (default:
    the labelled ones). Probes without a partner are left out.

    Two passes: best partner per probe within the labels, then a count of the
    gallery items that beat it.
    """
    # Read in each pass, and models may stand behind it.
    gallery = materialize(gallery.select("id", "label", "embedding"), "ranked-gallery")
    id_type = _type(gallery, "id")
    rows = gallery.count()
    wanted = gallery.filter(c("label").isNotNull()) if probes is None else probes
    best = best_same_identity(gallery, rows)
    ranked = wanted.select("id", "embedding").join(best, "id")
    blocks = block_count(rows)

    def beaten(left: Block, right: Block, _diagonal: bool) -> dict:
        values = scaled_similarities(left, right)
        best_code, best_id = left.column("best_code"), left.column("best_id")

        def wins(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            code = np.rint(values[rows, cols])
            won = code > best_code[rows]
            tied = np.flatnonzero(code == best_code[rows])
            won[tied] = right.ids[cols[tied]] < best_id[rows[tied]]
            return won

        # Rounding decides only next to the best code; further up a cell is ahead for sure.
        sure, near = values > best_code[:, None] + 0.75, values >= best_code[:, None] - 0.75
        ahead = np.count_nonzero(sure, axis=1)
        open_rows = np.flatnonzero(np.count_nonzero(near, axis=1) != ahead)
        rows, cols = np.nonzero(near[open_rows] & ~sure[open_rows])
        rows = open_rows[rows]
        np.add.at(ahead, rows, wins(rows, cols))
        # Neither the item itself nor its partner beats the partner.
        own = [same_cells(x, right.ids) for x in (left.ids, best_id)]
        cells = np.unique(np.concatenate([r * len(right.ids) + k for r, k in own]))
        rows, cols = np.divmod(cells, max(len(right.ids), 1))
        np.subtract.at(ahead, rows, wins(rows, cols))
        return {"id": left.ids, "ahead": ahead}

    counts = tile_join(
        ranked, gallery.select("id", "embedding"), beaten, f"id {id_type}, ahead long", blocks=(blocks, blocks))
    return counts.groupBy("id").agg((F.sum("ahead") + 1).alias("identity_rank"))


class _Levels:
    """Probes of a tile with the similarities of their partners as levels, and counts between the levels."""

    def __init__(self, probes: list[pa.Table], exclude_self: bool):
        self.table = pa.concat_tables(probes)
        self.exclude_self = exclude_self
        self.unit = unit_vectors(self.table.column("embedding"))
        self.place, self.group, self.chunk = (self.table.column(k).to_numpy() for k in ("place", "group", "chunk"))
        labels, self.code = np.unique(self.group, return_inverse=True)
        self.members = {int(g): np.flatnonzero(self.code == i) for i, g in enumerate(labels)}
        self.parts: list[list[np.ndarray]] = [[] for _ in self.place]
        self.levels: list[np.ndarray] | None = None

    def _cells(self, piece: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        unit = unit_vectors(piece.column("embedding"))
        group, place = piece.column("group").to_numpy(), piece.column("place").to_numpy()
        order = np.argsort(group, kind="stable")
        labels, starts = np.unique(group[order], return_index=True)
        same = {int(g): cols for g, cols in zip(labels, np.split(order, starts[1:])) if int(g) in self.members}
        return unit, place, same

    def add_partners(self, piece: pa.Table) -> None:
        unit, place, same = self._cells(piece)
        chunk = piece.column("chunk").to_numpy()
        for label, cols in same.items():
            rows = self.members[label]
            codes = np.rint(self.unit[rows] @ unit[cols].T * SCALE).astype(np.int64)
            for row, found in zip(rows, codes):
                own = found[(place[cols] != self.place[row]) & (chunk[cols] == self.chunk[row])]
                if len(own):
                    self.parts[row].append(own)

    def add_gallery(self, piece: pa.Table) -> None:
        if self.levels is None:
            self.levels = [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in self.parts]
            self.parts = []
            self.above = [np.zeros(len(x) + 1, np.int64) for x in self.levels]
            self.relevant = [np.zeros(len(x) + 1, np.int64) for x in self.levels]
        unit, place, same = self._cells(piece)
        codes = np.rint(self.unit @ unit.T * SCALE).astype(np.int64)
        for row, levels in enumerate(self.levels):
            # Levels at or below each similarity; a similarity counts for all of those.
            reach = np.searchsorted(levels, codes[row], "right")
            itself = np.flatnonzero(place == self.place[row])
            self.above[row] += np.bincount(reach, minlength=len(levels) + 1)
            if len(itself) and self.exclude_self:
                self.above[row][reach[itself[0]]] -= 1
            cols = same.get(int(self.group[row]))
            if cols is not None:
                self.relevant[row] += np.bincount(reach[cols], minlength=len(levels) + 1)
                if len(itself):
                    self.relevant[row][reach[itself[0]]] -= 1

    def counts(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per probe: gallery items, and partners, at or above each of its levels."""
        def upwards(counts: np.ndarray) -> np.ndarray:
            return np.cumsum(counts[:0:-1])[::-1]

        return [upwards(x) for x in self.above], [upwards(x) for x in self.relevant]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the count arrays of consecutive rows of one probe and chunk, and adds up the precisions."""
    names = ("place", "chunk")

    def finished(at, above, relevant):
        return pa.RecordBatch.from_pydict({
            "place": pa.array([at[0]], pa.int64()), "hits": pa.array([float((relevant / above).sum())]),
            "n": pa.array([len(above)], pa.int64())})

    held = None
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in names]))
        for row, key in enumerate(keys):
            above, relevant = (batch.column(k)[row].values.to_numpy() for k in ("above", "relevant"))
            if held is not None and held[0] == key:
                held = (key, held[1] + above, held[2] + relevant)
            else:
                if held is not None:
                    yield finished(*held)
                held = (key, above, relevant)
    if held is not None:
        yield finished(*held)


class _Held:
    """A gallery in the order of its places, as it was given; probes are ranked in it one by one."""

    def __init__(self, pieces: list[pa.Table]):
        order = np.argsort(np.concatenate([x.column("place").to_numpy() for x in pieces]))
        units = [x.column("embedding").combine_chunks() for x in pieces]
        flat = pa.concat_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in units])
        self.vectors = flat.take(pa.array(order))
        self.rows = len(order)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        found = np.empty((len(unit), self.rows), np.int32)
        for at in range(0, self.rows, BLOCK_ROWS):
            values = unit @ unit_vectors(pa.chunked_array([self.vectors.slice(at, BLOCK_ROWS)])).T
            values *= SCALE
            with np.errstate(invalid="ignore"):
                found[:, at:at + BLOCK_ROWS] = np.rint(values, out=values)
        return found

    def precision(self, codes: np.ndarray, place: int, group: int, n: int, exclude_self: bool) -> float:
        own, at = codes[place], place - group
        levels = np.sort(np.delete(codes[group:group + n], at))
        relevant = len(levels) - np.searchsorted(levels, levels, "left")
        above = self.rows - np.searchsorted(np.sort(codes), levels, "left")
        if exclude_self:
            above = above - (own >= levels)
        return float((relevant / above).mean())


def _ranked_whole(own: DataFrame, rows: int, exclude_self: bool) -> DataFrame:
    """``place, ap``: a task holds the gallery and lets its share of the probes pass, so a vector is copied
    once per task, and a probe's similarities exist while it is ranked."""
    tasks = max(min(SPREAD, -(-rows // 128)), min(3 * SPREAD, -(-rows // BLOCK_ROWS)), -(-rows // _PROBES_PER_TASK))
    columns = ["place", "group", "n", "embedding"]
    gallery = own.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    probes = own.filter(c("n") > 1).withColumn("_t", F.pmod(F.xxhash64("place"), F.lit(tasks)).cast("long"))

    def measured(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
        pieces: list[pa.Table] = []
        held = None
        for side, piece in parts:
            if side == 0:
                pieces.append(piece)
                continue
            if held is None:
                held, pieces = _Held(pieces), []
            unit = unit_vectors(piece.column("embedding"))
            place, group, n = (piece.column(k).to_numpy() for k in ("place", "group", "n"))
            step, ap = max(1, _CODES_HELD // held.rows), []
            for at in range(0, len(place), step):
                found = held.codes(unit[at:at + step])
                ap += [held.precision(codes, *x, exclude_self) for codes, x in zip(found, zip(
                    place[at:at + step].tolist(), group[at:at + step].tolist(), n[at:at + step].tolist()))]
            yield {"place": place, "ap": np.array(ap)}

    return streamed_tiles([gallery.select(*columns, "_t"), probes.select(*columns, "_t")], tasks, measured, "place long, ap double")


def average_precision(items: DataFrame, exclude_self: bool = False) -> DataFrame:
    """``id, ap``: tie-grouped average precision of each item that has a partner.

    By default the item itself stays in its ranking as a wrong answer, as the
    metric is usually reported for all-against-all matrices; ``exclude_self``
    takes it out.

    Items are numbered along (label, id). Up to ``_STRIPE_ROWS`` of them are held
    by each task as the gallery, and the probes are dealt out. More are cut into
    blocks of about ``_LEVELS_PER_BLOCK`` partner similarities. A task holds a block's probes,
    computes those similarities when the partners pass, and counts a whole
    stripe of the gallery against them; per probe one row leaves it, with the
    sum of the precisions where one stripe is the whole gallery. Partners of a
    label larger than a block come in chunks.
    """
    known = items.select("id", "label", "embedding").filter(
        c("label").isNotNull() & c("id").isNotNull() & c("embedding").isNotNull())
    placed = positions(known, ["label", "id"], "place")
    least = max(1, _LEVELS_PER_BLOCK // BLOCK_ROWS)
    n = c("n")
    whole = materialize(placed.groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("group")), "label-sizes")
    rows = whole.agg(F.sum("n")).first()[0] or 0
    if rows <= _STRIPE_ROWS:
        ap = _ranked_whole(placed.join(whole, "label"), max(rows, 1), exclude_self)
        return placed.select("id", "place").join(ap, "place").select("id", "ap")
    sizes = whole.withColumns({
        "chunks": F.ceil(n / _LEVELS_PER_BLOCK), "weight": F.greatest(F.ceil(n / F.ceil(n / _LEVELS_PER_BLOCK)), F.lit(least))})
    labels = materialize(running(
        sizes, [], ["label"], {"base": ("sum", F.when(n > 1, n * c("chunks") * c("weight")).otherwise(0))}, inclusive=False), "labels")
    seen = labels.agg(F.sum("n").alias("rows"), F.max("weight").alias("weight"),
                      F.max(F.when(n > 1, c("base") + n * c("chunks") * c("weight"))).alias("total")).first()
    if not seen["total"]:
        return known.select("id", F.lit(0.0).alias("ap")).limit(0)
    rows, total = seen["rows"], seen["total"]
    wanted = max(block_count(rows), min(SPREAD, -(-rows // 128)))
    per_block = max(min(_LEVELS_PER_BLOCK, -(-total // wanted)), seen["weight"])
    blocks, stripes = -(-total // per_block), -(-rows // _STRIPE_ROWS)

    def block(unit: Column) -> Column:
        return F.floor((c("base") + unit * c("weight")) / per_block).cast("long")

    own = placed.join(labels, "label").withColumn("nth", c("place") - c("group"))
    columns = ["place", "group", "chunk", "embedding"]
    partnered = own.filter(n > 1)
    probes = partnered.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), c("chunks") - 1))).withColumn(
        "_block", block(c("nth") * c("chunks") + c("chunk")))
    partners = partnered.withColumn("chunk", F.pmod("nth", c("chunks"))).withColumn(
        "_block", F.explode(F.sequence(block(F.lit(0)), block(n * c("chunks") - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))

    def tile(stripe: Column) -> Column:
        return (c("_block") * stripes + stripe).cast("long").alias("_t")

    sides = [df.withColumn("_stripe", every).select(*columns, tile(c("_stripe"))) for df in (probes, partners)]
    gallery = own.withColumn("chunk", F.lit(0).cast("long")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))
    sides.append(gallery.select(*columns, tile(block_of(c("place"), stripes))))

    def measured(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
        held, probes = None, []
        for side, piece in parts:
            if side == 0:
                probes.append(piece)
                continue
            if not probes:
                continue
            held = _Levels(probes, exclude_self) if held is None else held
            (held.add_partners if side == 1 else held.add_gallery)(piece)
        if held is None or held.levels is None:
            return
        above, relevant = held.counts()
        some = [i for i, x in enumerate(above) if len(x)]
        found = {"place": held.place[some], "chunk": held.chunk[some]}
        if stripes == 1:
            yield found | {"hits": [float((relevant[i] / above[i]).sum()) for i in some], "n": [len(above[i]) for i in some]}
        else:
            yield found | {"above": [above[i] for i in some], "relevant": [relevant[i] for i in some]}

    if stripes == 1:
        sums = streamed_tiles(sides, blocks, measured, "place long, chunk long, hits double, n long")
    else:
        counts = streamed_tiles(
            sides, blocks * stripes, measured, "place long, chunk long, above array<long>, relevant array<long>")
        sums = counts.repartition("place", "chunk").sortWithinPartitions("place", "chunk").mapInArrow(
            _added, "place long, hits double, n long")
    ap = sums.groupBy("place").agg((F.sum("hits") / F.sum("n")).alias("ap"))
    return placed.select("id", "place").join(ap, "place").select("id", "ap")


def mean_average_precision(items: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Mean of the items' average precision; 0 when no item has a partner."""
    return average_precision(items, exclude_self).agg(
        F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"), F.count("*").alias("n_queries"))


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """Mean of 1/rank over the probes that have a rank; 0 without any."""
    return ranks.agg(
        F.coalesce(F.avg(F.lit(1.0) / c("identity_rank")), F.lit(0.0)).alias("mrr"),
        F.count("identity_rank").alias("n_ranked"),
    )


def topk_accuracy(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of the ranked probes with rank <= k, one row per k."""
    counted = ranks.filter(c("identity_rank").isNotNull()).agg(
        *[F.count_if(c("identity_rank") <= k).alias(f"top_{k}") for k in ks],
        F.count("*").alias("n_ranked"),
    )
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), c(f"top_{k}").alias("hits")) for k in ks])
    share = F.when(c("n_ranked") > 0, c("row.hits") / c("n_ranked")).otherwise(F.lit(0.0))
    return counted.select(F.explode(rows).alias("row"), "n_ranked").select(
        c("row.k").alias("k"), share.alias("accuracy"), "n_ranked")
