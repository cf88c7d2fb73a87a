"""Different-identity pairs by numbered draws.

Slot 0, 1, 2, ... each names a pair by hashes of the seed and its number:
``weighting="identity"`` draws two labels and then a member of each,
``weighting="pair"`` two items, of which equal labels do not count. A pair
belongs to the first slot that names it, and the sample is the pairs of the
lowest slots. So one rule holds at every size, nothing depends on partitions,
and the work grows with the number of pairs that are asked for: slots are drawn
in doubling rounds until enough distinct pairs are found.

Asked for nearly all pairs, the rest may be rare: after as many slots as four
times the number of different-identity pairs, the pairs that no slot has named
follow by exponential keys of the same weights, which continues the draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelage.operators.prefix import positions
from pelage.operators.selection import HISTOGRAM_SCHEMA, Interval, bin_counts, order_statistics, table_bins
from pelage.operators.tiles import (
    BLOCK_ROWS, SCALE, Block, block_count, keep_upper, label_codes, pair_tiles, scaled_similarities, streamed_tiles, unit_vectors,
)
from pelage.session import materialize, scratch_dir, shuffles_removed
from pelage.sources.files import delete_folder

c = F.col

WEIGHTINGS = ("identity", "pair")
# A table of labels up to this many rows is broadcast, some 10 MB; the draws join larger ones by shuffle.
BROADCAST_LABELS = 200_000
# Pairs that meet one copy of a member; busier members are copied.
PAIRS_PER_COPY = 20_000
# Members whose vectors meet those of as many others in one task.
MEMBERS_PER_BLOCK = 4_096
# Draws of a tile after which repeated ones are dropped.
NUMBERS_HELD = 1 << 24
# Slots of one task.
SLOTS_PER_TASK = 1_000_000
# Pairs from which on cells are marked in bitmaps instead of listed; slots of one task and of one round of marking.
MARKED_FROM, MARKED_PER_TASK, MARKED_PER_ROUND = 1 << 22, 1 << 23, 1 << 28
# Members of a block of marked cells, and rows of it whose similarities a task holds.
MARKED_BLOCK, MARKED_ROWS = 8_192, 512
# Slots that are hashed at once.
HASHED = 1 << 16
# Slots per pair that is asked for in the first round, and per different pair before keys decide.
FIRST, LAST = 1.25, 4
_DIGITS = 15


def draw(seed: int, key: Column, half: int, n: Column) -> Column:
    """One of ``n`` numbers, from the first or second 60 bits of the hash of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1 + _DIGITS * half, _DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n)


def draw_sql(seed: int, key: str, half: int, n: str) -> str:
    """The same number as a SQL expression."""
    return f"(('0x' || substr(md5('{seed}|' || {key}), {1 + _DIGITS * half}, {_DIGITS}))::BIGINT % {n})"


def _drawn_numbers(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """``slot`` and, for the keys ``slot|0`` and ``slot|1``, both 60-bit numbers that ``draw`` takes from the hash."""
    start = f"{seed}|".encode()
    for batch in batches:
        slots = batch.column("slot").to_pylist()
        columns = {"slot": batch.column("slot")}
        for key in (0, 1):
            end = f"|{key}".encode()
            hashes = b"".join([md5(b"%b%d%b" % (start, x, end)).digest() for x in slots])
            high, low = np.frombuffer(hashes, ">u8").reshape(-1, 2).astype(np.uint64).T
            columns[f"u{key}0"] = pa.array((high >> np.uint64(4)).astype(np.int64))
            columns[f"u{key}1"] = pa.array((((high & np.uint64(15)) << np.uint64(56)) | (low >> np.uint64(8))).astype(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def packed_cells(cells: np.ndarray) -> bytes:
    """Distinct cells in order: their low bytes, then their high parts as ones at high part plus place (Elias-Fano)."""
    ones = np.zeros((int(cells[-1]) >> 8) + len(cells) if len(cells) else 0, bool)
    ones[(cells >> 8) + np.arange(len(cells))] = True
    return (cells & 255).astype(np.uint8).tobytes() + np.packbits(ones).tobytes()


def unpacked_cells(n: int, cells: bytes) -> np.ndarray:
    low, high = np.frombuffer(cells, np.uint8, n), np.unpackbits(np.frombuffer(cells, np.uint8, offset=n))
    return ((np.flatnonzero(high)[:n] - np.arange(n)) << 8) | low


def _skip(drawn: Column, other: Column) -> Column:
    """A number other than ``other`` from one that is drawn out of one fewer."""
    return drawn + F.when(drawn >= other, 1).otherwise(0)


class Negatives:
    """Exactly ``target`` different-identity pairs of ``items`` (``id, label``, any more), or all when there are fewer.

    Rows without a label or an id take no part. Ids may be of any type that can
    be sorted; rows of one id are items of their own.
    """

    def __init__(self, items: DataFrame, target: int, seed: int = 42, weighting: str = "identity"):
        if weighting not in WEIGHTINGS:
            raise ValueError(f"weighting is one of {WEIGHTINGS}, not {weighting!r}")
        self.spark, self.seed, self.weighting = items.sparkSession, seed, weighting
        known = items.filter(c("label").isNotNull() & c("id").isNotNull())
        self.members = positions(known, ["label", "id"], "place")
        sizes = self.members.groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        self.labels = materialize(positions(sizes, ["label"], "code").drop("label"), "member-labels")
        seen = self.labels.agg(F.count("*").alias("labels"), F.sum("n").alias("rows"), F.min("n").alias("least"),
                               F.sum((c("n") * c("n")).cast("decimal(38,0)")).alias("squares")).first()
        self.n_labels, self.rows, self.least = seen["labels"], seen["rows"] or 0, seen["least"] or 1
        self.different = int(self.rows ** 2 - int(seen["squares"] or 0)) // 2
        self.target = max(0, min(target, self.different))
        self.slots = 0

    @cached_property
    def pairs(self) -> DataFrame:
        """``low, high`` (places), ``n_low, n_high`` (sizes of their labels)."""
        return self._pairs()

    # -- drawing

    def _ends(self, slots: int, start: int = 0) -> DataFrame:
        """``slots`` slots from ``start`` on, with the place of both ends and the size of its label, in the order they are drawn."""
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-slots // SLOTS_PER_TASK))
        seed = self.seed
        slot = self.spark.range(start, start + slots, 1, tasks).withColumnRenamed("id", "slot").mapInArrow(
            lambda batches: _drawn_numbers(batches, seed), "slot long, u00 long, u01 long, u10 long, u11 long")

        def drawn_of(key: int, half: int, n: Column) -> Column:
            return F.pmod(c(f"u{key}{half}"), n)

        labels = F.broadcast(self.labels) if self.n_labels <= BROADCAST_LABELS else self.labels
        if self.weighting == "identity":
            code_a = drawn_of(0, 0, F.lit(self.n_labels))
            code_b = _skip(drawn_of(0, 1, F.lit(self.n_labels - 1)), c("code_a"))
            drawn = slot.withColumn("code_a", code_a).withColumn("code_b", code_b)
            for side, half in (("a", 0), ("b", 1)):
                own = labels.select(*[c(k).alias(f"{k}_{side}") for k in self.labels.columns])
                drawn = drawn.join(own, f"code_{side}").withColumn(
                    f"place_{side}", c(f"first_{side}") + drawn_of(1, half, c(f"n_{side}")))
        else:
            place_a = drawn_of(0, 0, F.lit(self.rows))
            place_b = _skip(drawn_of(0, 1, F.lit(self.rows - 1)), c("place_a"))
            drawn = slot.withColumn("place_a", place_a).withColumn("place_b", place_b)
            own = self.members.select("label", "place")
            sized = own.join(own.groupBy("label").agg(F.count("*").alias("n")), "label")
            for side in "ab":
                drawn = drawn.join(sized.select(*[c(k).alias(f"{k}_{side}") for k in sized.columns]), f"place_{side}")
            drawn = drawn.filter(c("label_a") != c("label_b"))
        return drawn

    def _drawn(self, slots: int, *sized: str, start: int = 0) -> DataFrame:
        """``slot, low, high`` and, of ``sized``, the sizes of their labels: what each of the slots from ``start`` on names."""
        drawn = self._ends(slots, start)
        low_first = c("place_a") < c("place_b")
        ends = {f"{new}_{end}" if new else end: F.when(low_first == (end == "low"), c(f"{old}_a")).otherwise(c(f"{old}_b"))
                for end in ("low", "high") for new, old in (("", "place"), ("n", "n"))}
        return drawn.select("slot", *[ends[name].alias(name) for name in ("low", "high", *sized)])

    def _named(self, slots: int) -> DataFrame:
        """``low, high, n_low, n_high, slot``: pairs that the first slots name, each with its first slot."""
        return self._drawn(slots, "n_low", "n_high").groupBy("low", "high", "n_low", "n_high").agg(F.min("slot").alias("slot"))

    def _pairs(self) -> DataFrame:
        if not self.target:
            return self.spark.createDataFrame([], "low long, high long, n_low long, n_high long")
        if self.target == self.different:
            return self._listed()
        last = LAST * self.different
        slots = min(int(FIRST * self.target) + 64, last)
        while True:
            self.slots = slots
            named = materialize(self._named(slots), "negative-pairs")
            found, cut = order_statistics(
                table_bins(named, "slot"), 0, slots, lambda n: [self.target - 1] if n >= self.target else [])
            if found >= self.target:
                return named.filter(c("slot") <= cut[self.target - 1]).drop("slot")
            if slots == last:
                return named.drop("slot").unionByName(self._rest(named, self.target - found))
            slots = min(2 * slots, last)

    def _listed(self) -> DataFrame:
        """All different-identity pairs, for samples of their order of size."""
        sizes = self.members.groupBy("label").agg(F.count("*").alias("n"))
        own = self.members.select(c("place").alias("id"), "label").join(sizes, "label")

        def listed(left: Block, right: Block, diagonal: bool) -> dict:
            a, b = label_codes(left, right)
            rows, cols = np.nonzero(keep_upper(a[:, None] != b[None, :], left, right, diagonal))
            one, two, n, m = left.ids[rows], right.ids[cols], left.column("n")[rows], right.column("n")[cols]
            swap = one > two
            return {"low": np.where(swap, two, one), "high": np.where(swap, one, two),
                    "n_low": np.where(swap, m, n), "n_high": np.where(swap, n, m)}

        return pair_tiles(own, listed, "low long, high long, n_low long, n_high long", blocks=block_count(self.rows), vector=None)

    def _rest(self, named: DataFrame, wanted: int) -> DataFrame:
        key = F.concat_ws("|", "low", "high")
        u = (draw(self.seed, key, 0, F.lit(1 << 60)) + 0.5) / float(1 << 60)
        weight = c("n_low") * c("n_high") if self.weighting == "identity" else F.lit(1)
        left = self._listed().join(named, ["low", "high"], "left_anti").withColumn("key", -F.log(u) * weight)
        return positions(left, ["key", "low", "high"], "turn").filter(c("turn") < wanted).drop("key", "turn")

    # -- members of pairs

    def _copies(self, n: Column) -> Column:
        """Copies of a member of a label with ``n`` members, by the pairs it may be in."""
        self.pairs  # Drawing them sets the number of slots.
        if self.target == self.different:
            uses = F.lit(self.rows) - n
        elif self.weighting == "identity":
            uses = F.least(F.lit(self.rows) - n, F.ceil(2.0 * self.slots / self.n_labels / n))
        else:
            uses = F.lit(min(self.rows, -(-2 * self.slots // max(self.rows, 1))))
        return F.greatest(F.ceil(uses / PAIRS_PER_COPY), F.lit(1)).cast("int")

    def with_members(self, *columns: str) -> DataFrame:
        """The pairs with ``columns`` of both members, named ``<column>_low`` and ``<column>_high``.

        Members that are in very many pairs, such as the only one of a label
        among few, are copied and their pairs dealt out over the copies.
        """
        busy = self.labels.select("first", "n", self._copies(c("n")).alias("copies")).filter(c("copies") > 1)
        places = busy.select(F.explode(F.sequence(c("first"), c("first") + c("n") - 1)).alias("place"), "copies")
        pairs = self.pairs
        for end in ("low", "high"):
            own = self.members.select("place", *columns).join(places, "place", "left").select(
                c("place").alias(end), F.explode(F.sequence(F.lit(0), F.coalesce(c("copies"), F.lit(1)) - 1)).alias(f"copy_{end}"),
                *[c(k).alias(f"{k}_{end}") for k in columns])
            turn = F.pmod(F.xxhash64("low", "high"), self._copies(c(f"n_{end}"))).cast("int")
            pairs = pairs.withColumn(f"copy_{end}", turn).join(own, [end, f"copy_{end}"]).drop(f"copy_{end}")
        return pairs

    def ids(self) -> DataFrame:
        """``id_a, id_b`` with ``id_a <= id_b``."""
        both = self.with_members("id")
        return both.select(F.least("id_low", "id_high").alias("id_a"), F.greatest("id_low", "id_high").alias("id_b"))

    def codes(self) -> DataFrame:
        """``code``: the cosine of each pair in units of ``SCALE``; members need an ``embedding``."""
        last = LAST * self.different
        slots = min(int(FIRST * self.target) + 64, last)
        while self.target and self.target < self.different:
            measured = materialize(self._measured(self._drawn(slots)), "drawn-codes")
            found, cut = order_statistics(
                table_bins(measured, "slot"), 0, slots, lambda n: [self.target - 1] if n >= self.target else [])
            if found >= self.target:
                return measured.filter(c("slot") <= cut[self.target - 1]).select("code")
            if slots == last:
                break
            slots = min(2 * slots, last)
        return self._measured(self.pairs.select(F.lit(0).cast("long").alias("slot"), "low", "high")).select("code")

    def _measured(self, drawn: DataFrame) -> DataFrame:
        """``slot, code`` of each distinct pair of ``slot, low, high``, with the first slot that names it.

        Members are cut into blocks by place and a pair of blocks is a tile: its
        vectors come once, then its pairs, each as one number (places in the
        tile, then slot) whose sort puts equal pairs in a row. So no pair
        travels with its vectors.
        """
        digits = max(1, (LAST * self.different).bit_length())
        size = min(MEMBERS_PER_BLOCK, 1 << (62 - digits) // 2, -(-self.rows // block_count(self.rows)))
        blocks = -(-self.rows // size)

        def tile(low: Column, high: Column) -> Column:
            return (low * blocks + high).cast("long").alias("_t")

        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        members = self.members.filter(c("embedding").isNotNull()).withColumn(
            "_own", F.expr(f"place div {size}")).withColumn("_other", every)
        vectors = members.select(
            tile(F.least("_own", "_other"), F.greatest("_own", "_other")), c("place").alias("number"), "embedding")
        low, high = (F.expr(f"{x} div {size}") for x in ("low", "high"))
        inside = (c("low") - low * size) * size + c("high") - high * size
        pairs = drawn.select(
            tile(low, high), (F.shiftleft(inside.cast("long"), digits) + c("slot")).alias("number"),
            # Empty, not NULL: Arrow's list writer goes over all rows of a batch before each NULL.
            F.array().cast(self.members.schema["embedding"].dataType).alias("embedding"))

        def distinct(held: list[np.ndarray]) -> np.ndarray:
            numbers = np.sort(np.concatenate(held))
            cell = numbers >> digits
            first = np.ones(len(cell), bool)
            first[1:] = cell[1:] != cell[:-1]
            return numbers[first]

        def measured(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
            given: list[pa.Table] = []
            held, n = [], 0
            for side, piece in parts:
                if side == 0:
                    given.append(piece)
                    continue
                held.append(piece.column("number").to_numpy())
                n += len(held[-1])
                if n > NUMBERS_HELD:
                    held = [distinct(held)]
                    n = 0
            if not held:
                return
            numbers = distinct(held)
            both = pa.concat_tables(given) if given else None
            place = both.column("number").to_numpy() if given else np.zeros(0, np.int64)
            unit = unit_vectors(both.column("embedding")) if given else np.zeros((0, 0))
            own = np.unique(place // size)
            # Row of each place of the first and the last block of the tile; a member without a vector has none.
            rows = [np.full(size, -1, np.int64) for _ in range(2)]
            for row, block in zip(rows, (own[:1], own[-1:])):
                at = np.flatnonzero(place // size == block)
                row[place[at] % size] = at
            for at in range(0, len(numbers), 4 * BLOCK_ROWS):
                some = numbers[at:at + 4 * BLOCK_ROWS]
                one, two = np.divmod(some >> digits, size)
                a, b = rows[0][one], rows[1][two]
                if min(a.min(), b.min()) < 0:
                    raise ValueError("vectors must be present and of one length")
                yield {"slot": some & ((1 << digits) - 1),
                       "code": np.rint(np.einsum("ij,ij->i", unit[a], unit[b]) * SCALE).astype(np.int64)}

        return streamed_tiles([vectors, pairs], blocks * (blocks + 1) // 2, measured, "slot long, code long")

    # -- samples of very many pairs

    def histograms(self) -> Callable[[list[Interval]], DataFrame]:
        """Counts of the pairs' cosines per bin, as ``order_statistics`` asks for them; members need an ``embedding``.

        Very many pairs are no rows: all there are come from the tiles of all
        members, and of others the cells are marked in a bitmap per pair of blocks.
        """
        if self.target and self.target == self.different:
            return self._all_bins()
        marks = self._marks() if self.target > MARKED_FROM and self.n_labels <= BROADCAST_LABELS else None
        return table_bins(self.codes(), "code") if marks is None else self._marked_bins(*marks)

    def _all_bins(self) -> Callable[[list[Interval]], DataFrame]:
        items = self.members.select(c("place").alias("id"), "label", "embedding")
        return lambda intervals: impostor_bins(items, block_count(self.rows), intervals)

    def _marks(self) -> tuple[DataFrame, int, int] | None:
        """``_t, n, cells``: the bitmap of each tile's cells that are in the sample, with the size and number of blocks;
        None where slots repeat too often.

        A round draws no more slots than pairs are missing, so it cannot find too many; the last few are found slot by slot.
        """
        digits = max(1, (LAST * self.different).bit_length())
        size = max(1, min(MARKED_BLOCK, math.isqrt(1 << (62 - digits)), -(-self.rows // block_count(self.rows))))
        blocks = -(-self.rows // size)
        marks, path, start, found = None, None, 0, 0
        last = LAST * self.different
        with shuffles_removed(self.spark):
            while (missing := self.target - found) > MARKED_FROM:
                slots = min(MARKED_PER_ROUND, missing)
                if start + slots > last:
                    return None
                marks, path = self._merged(marks, self._packed(start, slots, size, blocks), size, blocks, path)
                before, found = found, marks.agg(F.sum("n")).first()[0] or 0
                start += slots
                if 4 * (found - before) < slots:
                    return None
            slots = int(FIRST * missing) + 64
            while missing:
                if start + slots > last:
                    return None
                fresh = materialize(self._unmarked(marks, self._drawn(slots, start=start), size, blocks, digits), "unmarked-pairs")
                n, cut = order_statistics(
                    table_bins(fresh, "slot"), start, start + slots, lambda n: [missing - 1] if n >= missing else [])
                if n >= missing:
                    chosen = fresh.filter(c("slot") <= cut[missing - 1]).select("_t", "number")
                    marks, path = self._merged(marks, chosen, size, blocks, path)
                    break
                slots *= 2
        return marks, size, blocks

    def _packed(self, start: int, slots: int, size: int, blocks: int) -> DataFrame:
        """``_t, n, cells``: the cells that the slots from ``start`` on name, packed per tile and range of slots."""
        rows = self.labels.select("code", "n", "first").orderBy("code").toArrow()
        sizes, firsts = rows.column("n").to_numpy(), rows.column("first").to_numpy()
        seed, by_label, members = self.seed, self.weighting == "identity", self.rows
        each = min(MARKED_PER_TASK, -(-slots // self.spark.sparkContext.defaultParallelism))

        def ends(u: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            many = len(sizes) if by_label else members
            a, b = u["u00"] % many, u["u01"] % (many - 1)
            b += b >= a
            if by_label:
                return firsts[a] + u["u10"] % sizes[a], firsts[b] + u["u11"] % sizes[b]
            differ = np.searchsorted(firsts, a, "right") != np.searchsorted(firsts, b, "right")
            return a[differ], b[differ]

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for first in (x for batch in batches for x in batch.column("id").to_pylist()):
                held = []
                end = min(first + each, start + slots)
                for at in range(first, end, HASHED):
                    some = pa.RecordBatch.from_pydict({"slot": pa.array(range(at, min(at + HASHED, end)), pa.int64())})
                    for drawn in _drawn_numbers(iter([some]), seed):
                        a, b = ends({k: drawn.column(k).to_numpy() for k in ("u00", "u01", "u10", "u11")})
                        low, high = np.minimum(a, b), np.maximum(a, b)
                        held.append(((low // size) * blocks + high // size) * (size * size) + (low % size) * size + high % size)
                numbers = np.unique(np.concatenate(held))
                tile = numbers // (size * size)
                for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(tile)) + 1):
                    if len(part):
                        yield pa.RecordBatch.from_pydict({
                            "_t": pa.array([int(tile[part[0]])], pa.int64()), "n": pa.array([len(part)], pa.int64()),
                            "cells": pa.array([packed_cells(numbers[part] % (size * size))], pa.binary())})

        ranges = self.spark.range(start, start + slots, each, -(-slots // each))
        return ranges.mapInArrow(packed, "_t long, n long, cells binary")

    @staticmethod
    def _tile_rows(df: DataFrame) -> DataFrame:
        """A side of a tile of marks: a bitmap or packed cells with their number, or a cell of its own."""
        kinds = {"_t": "long", "n": "long", "cells": "binary", "number": "long"}
        return df.select(*[(c(k) if k in df.columns else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])

    def _marked_tiles(self, marks: DataFrame | None, found: DataFrame, blocks: int, fn: Callable, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], "_t long, n long, cells binary") if marks is None else marks
        return streamed_tiles([self._tile_rows(x) for x in (empty, found)], blocks * (blocks + 1) // 2, fn, schema)

    def _merged(self, marks: DataFrame | None, found: DataFrame, size: int, blocks: int, old: str | None) -> tuple[DataFrame, str]:
        """The marks with the found cells, written, and the folder; the ``old`` folder goes."""
        def merged(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
            tile, seen = None, np.zeros(size * size, bool)
            for side, piece in parts:
                tile = piece.column("_t")[0].as_py()
                if side == 0:
                    seen = _bits(piece, size)
                elif piece.column("cells").null_count:
                    seen[piece.column("number").to_numpy()] = True
                else:
                    for n, cells in zip(piece.column("n").to_pylist(), piece.column("cells").to_pylist()):
                        seen[unpacked_cells(n, cells)] = True
            yield {"_t": [tile], "n": [int(np.count_nonzero(seen))], "cells": [np.packbits(seen).tobytes()]}

        path, schema = scratch_dir(self.spark, "marked-pairs"), "_t long, n long, cells binary"
        self._marked_tiles(marks, found, blocks, merged, schema).write.option("compression", "zstd").parquet(path)
        if old:
            delete_folder(self.spark, old)
        return self.spark.read.schema(schema).parquet(path), path

    def _unmarked(self, marks: DataFrame | None, drawn: DataFrame, size: int, blocks: int, digits: int) -> DataFrame:
        """``_t, number, slot``: the cells of drawn pairs that are not marked, each with its first slot."""
        low, high = (F.expr(f"{x} div {size}") for x in ("low", "high"))
        inside = (c("low") - low * size) * size + c("high") - high * size
        pairs = drawn.select((low * blocks + high).cast("long").alias("_t"), (F.shiftleft(inside.cast("long"), digits) + c("slot")).alias("number"))

        def unmarked(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
            tile, seen, held = None, None, []
            for side, piece in parts:
                tile = piece.column("_t")[0].as_py()
                if side == 0:
                    seen = _bits(piece, size)
                else:
                    held.append(piece.column("number").to_numpy())
            if held:
                numbers = np.sort(np.concatenate(held))
                cell = numbers >> digits
                first = np.ones(len(cell), bool)
                first[1:] = cell[1:] != cell[:-1]
                if seen is not None:
                    first &= ~seen[cell]
                yield {"_t": np.full(first.sum(), tile), "number": cell[first], "slot": numbers[first] & ((1 << digits) - 1)}

        return self._marked_tiles(marks, pairs, blocks, unmarked, "_t long, number long, slot long")

    def _marked_bins(self, marks: DataFrame, size: int, blocks: int) -> Callable[[list[Interval]], DataFrame]:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        members = self.members.withColumn("_own", F.expr(f"place div {size}")).withColumn("_other", every)
        tile = F.least("_own", "_other") * blocks + F.greatest("_own", "_other")
        kind = self.members.schema["embedding"].dataType
        vectors = members.select(tile.cast("long").alias("_t"), "place", "embedding", F.lit(b"").alias("cells"))
        bitmaps = marks.select("_t", F.lit(0).cast("long").alias("place"), F.array().cast(kind).alias("embedding"), "cells")

        def tiles(intervals: list[Interval]) -> DataFrame:
            def counted(parts: Iterator[tuple[int, pa.Table]]) -> Iterator[dict]:
                given, seen = [], None
                for side, piece in parts:
                    if side == 0:
                        given.append(piece)
                    else:
                        seen = _bits(piece, size).reshape(size, size)
                if seen is None:
                    return
                both = pa.concat_tables(given)
                place, unit = both.column("place").to_numpy(), unit_vectors(both.column("embedding"))
                order = np.argsort(place)
                place, unit = place[order], unit[order]
                own = place // size
                one, two = (unit[own == x] for x in (own[0], own[-1]))
                held = []
                for at in range(0, len(one), MARKED_ROWS):
                    values = (one[at:at + MARKED_ROWS] @ two.T)[seen[at:at + MARKED_ROWS, :len(two)][:len(one) - at]] * SCALE
                    held.append(np.rint(values).astype(np.int64))
                yield bin_counts(np.concatenate(held), intervals)

            return streamed_tiles([vectors, bitmaps], blocks * (blocks + 1) // 2, counted, HISTOGRAM_SCHEMA)

        return tiles


def _bits(piece: pa.Table, size: int) -> np.ndarray:
    """Cells of a tile that its one bitmap marks."""
    return np.unpackbits(np.frombuffer(piece.column("cells")[0].as_py(), np.uint8), count=size * size).view(bool)


def impostor_bins(items: DataFrame, blocks: int, intervals: list[Interval]) -> DataFrame:
    """Histograms of the similarities of all different-identity pairs."""
    least, most = min(x[0] for x in intervals), max(x[1] for x in intervals)

    def histogram(left: Block, right: Block, diagonal: bool) -> dict:
        a, b = label_codes(left, right)
        keep = keep_upper(a[:, None] != b[None, :], left, right, diagonal)
        values = scaled_similarities(left, right)
        # Only cells that can round into an interval are rounded.
        keep &= values >= least - 1
        keep &= values <= most
        return bin_counts(np.rint(values[keep]).astype(np.int64), intervals)

    return pair_tiles(items, histogram, HISTOGRAM_SCHEMA, blocks=blocks)
