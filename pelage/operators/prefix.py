"""Places and running totals along an order, over a whole table without one big partition.

A window without a partition key, or with one that holds a third of the rows,
sorts in a single task. Here Spark's range sort cuts the table, along the keys
and the order together, into as many partitions as its size asks for, so a key
with very many rows is cut too. The sorted rows are written with what their own
partition says about them, and what the partitions before add is a table of
one row per partition (and key), summed in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelage.session import materialize

c = F.col

# Sorted partitions whose totals one task sums.
PARTS_PER_BLOCK = 1024


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until the table has no such column."""
    found = []
    for name in names:
        while name in df.columns or name in found:
            name = "_" + name
        found.append(name)
    return found


def _before_parts(totals: DataFrame, part: str, name: str) -> DataFrame:
    """``part`` and the sum of ``name`` over all earlier parts: within blocks of parts, then over the blocks."""
    blocked = totals.withColumn("_part_block", F.floor(c(part) / PARTS_PER_BLOCK))
    inside = Window.partitionBy("_part_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row per PARTS_PER_BLOCK partitions.
    over = Window.orderBy("_part_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_part_block").agg(F.sum(name).alias(name)).select(
        c("_part_block").alias("_of_block"), F.coalesce(F.sum(name).over(over), F.lit(0)).alias("_blocks"))
    within = blocked.select(part, "_part_block", F.coalesce(F.sum(name).over(inside), F.lit(0)).alias("_in"))
    return within.join(blocks, c("_part_block") == c("_of_block")).select(part, (c("_in") + c("_blocks")).alias(name))


def positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row along ``order``, rows of equal order in any turn."""
    at, part, before = unused(df, "_at", "_part", "_before")
    placed = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "positions")
    # The partition stands above 33 bits, the row's place in it below.
    number = F.shiftright(at, 33)
    totals = placed.groupBy(number.alias(part)).agg(F.count(F.lit(1)).alias(before))
    return placed.join(_before_parts(totals, part, before), number == c(part)).select(
        *df.columns, (c(before) + c(at).bitwiseAND((1 << 33) - 1)).cast("long").alias(name))


def row_numbers(df: DataFrame, keys: list[str], order_key: Column, ties: list[str], name: str) -> DataFrame:
    """1-based row number per ``keys`` in the order of ``order_key``, then ``ties``."""
    key, place, first, *same = unused(df, "_key", "_place", "_first", *[f"_of_{k}" for k in keys])
    placed = positions(df.withColumn(key, order_key), [*keys, key, *ties], place)
    if not keys:
        return placed.select(*df.columns, (c(place) + 1).alias(name))
    starts = placed.groupBy(*[c(k).alias(s) for k, s in zip(keys, same)]).agg(F.min(place).alias(first))
    match = F.lit(True)
    for k, s in zip(keys, same):
        match &= c(k).eqNullSafe(c(s))
    return placed.join(starts, match).select(*df.columns, (c(place) - c(first) + 1).alias(name))


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str], values: list[tuple[str, str]],
          part: str, inclusive: bool) -> Iterator[pa.RecordBatch]:
    """Running values of a sorted partition, begun anew with each key; ``values``: (column, ``sum`` or ``max``)."""
    number = TaskContext.get().partitionId()
    last, state = None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        begins = np.zeros(n, bool)
        for k in keys:
            codes = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
            begins[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if first != last:
            state = {}
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
        cuts = [0, *np.flatnonzero(begins).tolist(), n]
        columns = {x: batch.column(x) for x in names}
        columns[part] = pa.array(np.full(n, number, np.int64))
        for column, kind in values:
            given = batch.column(column).to_numpy(zero_copy_only=False)
            out = np.empty(n, given.dtype)
            masks = np.zeros(n, bool)
            for low, high in zip(cuts[:-1], cuts[1:]):
                held = state.get(column) if low == 0 else None
                piece = given[low:high]
                run = np.cumsum(piece) if kind == "sum" else np.maximum.accumulate(piece)
                if held is not None:
                    run = run + held if kind == "sum" else np.maximum(run, held)
                if inclusive:
                    out[low:high] = run
                else:
                    out[low + 1:high] = run[:-1]
                    out[low] = 0 if held is None else held
                    masks[low] = held is None and kind == "max"
                if high == n:
                    state[column] = run[-1]
            columns[column] = pa.array(out, mask=masks)
        yield pa.RecordBatch.from_pydict(columns)


def running(
    df: DataFrame, keys: list[str], order: list[Column | str],
    values: dict[str, tuple[str, Column]], inclusive: bool = True,
) -> DataFrame:
    """Adds running sums or maxima per ``keys`` along ``order``, which no two rows of a key share.

    ``values`` maps a new column to (``"sum"`` or ``"max"``, a number without
    NULLs). With ``inclusive=False`` the current row is left out (sum 0, max
    NULL at first).
    """
    agg = {"sum": F.sum, "max": F.max}
    part, of_part, *rest = unused(
        df, "_part", "_of_part", *[f"_of_{k}" for k in keys], *[f"_v_{n}" for n in values], *[f"_g_{n}" for n in values], *[f"_b_{n}" for n in values])
    k = len(keys)
    same, own, given, before = rest[:k], rest[k:k + len(values)], rest[k + len(values):k + 2 * len(values)], rest[k + 2 * len(values):]
    kinds = [kind for kind, _ in values.values()]
    inputs = df.withColumns({x: expr for x, (_, expr) in zip(own, values.values())})
    inputs = inputs.withColumns({g: c(x) for g, x in zip(given, own)}).orderBy(*keys, *order)
    names = [*df.columns, *given]
    fields = [*[inputs.schema[x] for x in names], T.StructField(part, T.LongType()),
              *[T.StructField(x, inputs.schema[x].dataType) for x in own]]
    pairs = list(zip(own, kinds))
    written = materialize(inputs.mapInArrow(
        lambda b: _scan(b, names, keys, pairs, part, inclusive), T.StructType(fields)), "running")
    # One row per partition and key in it.
    totals = written.groupBy(part, *keys).agg(*[agg[kind](g).alias(b) for g, b, kind in zip(given, before, kinds)])
    over = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        ahead = totals.select(
            c(part).alias(of_part), *[c(x).alias(s) for x, s in zip(keys, same)],
            *[agg[kind](b).over(over).alias(b) for b, kind in zip(before, kinds)])
    else:
        ahead = totals.select(c(part).alias(of_part))
        for b, kind in zip(before, kinds):
            if kind != "sum":
                raise ValueError("a running maximum needs keys")
            ahead = ahead.join(_before_parts(totals.select(part, b), part, b), c(of_part) == c(part)).drop(part)
    match = c(part) == c(of_part)
    for x, s in zip(keys, same):
        match &= c(x).eqNullSafe(c(s))
    joined = written.join(ahead, match)
    return joined.select(*df.columns, *[
        (c(x) + F.coalesce(c(b), F.lit(0))).alias(n) if kind == "sum" else F.greatest(x, b).alias(n)
        for n, x, b, kind in zip(values, own, before, kinds)])
