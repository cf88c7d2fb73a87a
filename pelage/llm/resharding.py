"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones a
minimum-cost flow gives the transfers that move the fewest bytes; documents
then follow the flow, and only files that a transfer touches are rewritten.
The driver sees one number per pair of shards and the few documents that are a
sizeable part of a shard; all documents stay distributed.

Cases: a NULL text has size ``overhead``; rows that repeat are placed one by
one; a NULL id or old shard is a value of its own; an empty table gives an
empty plan; further columns stay with their rows (``rewrite``).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelage.llm.storage import stored
from pelage.operators.prefix import unused

c = F.col

# A document above this part of a shard's capacity is placed by itself; there
# are at most LARGE_PART * shards of them.
LARGE_PART = 256
BLOCK_ROWS = 2_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Transfers (i, j) -> amount of least total ``cost(i, j)``, by successive shortest paths.

    ``sum(supply)`` may not exceed ``sum(demand)``. Works on shards, whose
    number does not depend on the data.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # target, capacity, cost, index of the reverse arc

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        graph[a].append([b, capacity, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(supply):
        arc(source, i, amount, 0)
        for j in range(m):
            arc(i, n + j, amount, cost(i, j))
    for j, room in enumerate(demand):
        arc(n + j, sink, room, 0)
    potential = [0] * len(graph)
    while True:
        distance: list[float] = [float("inf")] * len(graph)
        distance[source] = 0
        via: list = [None] * len(graph)
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for k, (b, capacity, price, _) in enumerate(graph[a]):
                reach = d + price + potential[a] - potential[b]
                if capacity > 0 and reach < distance[b]:
                    distance[b], via[b] = reach, (a, k)
                    heapq.heappush(queue, (reach, b))
        if via[sink] is None:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        amount, node = None, sink
        while node != source:
            a, k = via[node]
            amount = graph[a][k][1] if amount is None else min(amount, graph[a][k][1])
            node = a
        node = sink
        while node != source:
            a, k = via[node]
            graph[a][k][1] -= amount
            graph[node][graph[a][k][3]][1] += amount
            node = a
    return {(i, a[0] - n): graph[a[0]][a[3]][1]
            for i in range(n) for a in graph[i] if n <= a[0] < n + m and graph[a[0]][a[3]][1] > 0}


def near_equal(total: int, shards: int) -> list[int]:
    """Capacities that add up to the total and differ by at most one."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def _place_large(large: list[tuple], room: list[int]) -> tuple[dict, list[int]]:
    """Largest first: all that fit stay in their shard, then the others go where most room is left."""
    room, where, moving = list(room), {}, []
    for size, key, old in sorted(large, key=lambda x: (-x[0], str(x[1]))):
        if old < len(room) and room[old] >= size:
            room[old] -= size
            where[key] = old
        else:
            moving.append((size, key))
    for size, key in moving:
        target = max(range(len(room)), key=lambda j: (room[j], -j))
        room[target] -= size
        where[key] = target
    return where, room


def plan(docs: DataFrame, row_key: Column, size: Column, old_shard: Column, old_shards: int, new_shards: int,
         cost=lambda i, j: int(i != j)) -> DataFrame:
    """``row, key, size, old, shard`` (new shard); ``row`` holds all columns of a document, whatever their names.

    ``row_key`` orders the documents of a shard and should tell rows apart.
    Within an old shard the documents lie on a line of bytes; each transfer of
    the flow is an interval of it and takes the documents whose middle it
    holds. Positions are sums over hashed blocks of bounded size, so no task
    gets a whole shard.
    """
    rows = stored(docs.select(F.struct("*").alias("row"), row_key.alias("key"), size.cast("long").alias("size"),
                              F.coalesce(F.pmod(old_shard, F.lit(old_shards)), F.lit(0)).cast("int").alias("old")),
                  "reshard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = near_equal(total, new_shards)
    limit = max(1, capacity[0] // LARGE_PART)
    # More than `limit` bytes each: at most LARGE_PART + 1 per new shard.
    large = [tuple(r) for r in rows.where(c("size") > limit).select("size", "key", "old").collect()]
    where, room = _place_large(large, capacity)
    small = rows.where(c("size") <= limit)
    blocks = max(1, -(-count // BLOCK_ROWS))
    small = small.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    sizes = small.groupBy("old", "_block").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("old", "_block", "_bytes", F.coalesce(
        F.sum("_bytes").over(before), F.lit(0)).alias("_from")), "reshard-blocks")
    supply = [0] * old_shards
    for row in starts.groupBy("old").agg(F.sum("_bytes").alias("n")).collect():
        supply[row["old"]] = row["n"]
    # Large documents may overfill a shard; what lacks elsewhere is spread evenly.
    room = [max(0, r) for r in room]
    for j, extra in enumerate(near_equal(max(0, sum(supply) - sum(room)), new_shards)):
        room[j] += extra
    flow = min_cost_flow(supply, room, cost)
    within = Window.partitionBy("old", "_block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    middle = (c("_from") + F.coalesce(F.sum("size").over(within), F.lit(0)) + c("size") / 2)
    placed = small.join(starts.drop("_bytes"), ["old", "_block"])
    target = F.lit(None).cast("int")
    for i in range(old_shards):
        parts = [(j, flow[i, j]) for j in range(new_shards) if (i, j) in flow]
        end, branch = sum(n for _, n in parts), F.lit(parts[-1][0] if parts else i % new_shards)
        for j, n in reversed(parts):
            branch = F.when(c("_middle") < end, F.lit(j)).otherwise(branch)
            end -= n
        target = F.when(c("old") == i, branch).otherwise(target)
    placed = placed.withColumn("_middle", middle).withColumn("shard", target.cast("int"))
    fixed = rows.sparkSession.createDataFrame(
        [(k, j) for k, j in where.items()], rows.select(c("key"), c("old").alias("shard")).schema)
    fixed = fixed.withColumnRenamed("key", "_fixed")
    alone = rows.where(c("size") > limit).join(fixed, c("key").eqNullSafe(c("_fixed")))
    columns = [*rows.columns, "shard"]
    return placed.select(columns).union(alone.select(columns))


def slots(placed: DataFrame, shards: int) -> DataFrame:
    """``placed`` with ``slot``: gapless numbers from 0 within ``shard``, old rows' order by key."""
    rows = stored(placed, "reshard-placed")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    keyed = rows.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_block").orderBy("key")
    return keyed.join(starts, ["shard", "_block"]).withColumn(
        "slot", c("_from") + F.row_number().over(within) - 1).drop("_from", "_block")


def transfers(placed: DataFrame) -> DataFrame:
    """``old_shard, new_shard, docs, bytes`` of every block transfer; equal shards stay in place."""
    return placed.groupBy(c("old").alias("old_shard"), c("shard").alias("new_shard")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("bytes"))


def rewrite(docs: DataFrame, key: Column, placed: DataFrame, path: str) -> DataFrame:
    """Write the documents of every new shard that a transfer touches to ``path``, a folder per shard; the manifest of these.

    Shards whose rows all stay and that lose none keep their old files. Rows
    of equal key go together, to the lowest of their shards. The documents are
    shuffled once, to their places by key; each task then writes its part of
    every shard.
    """
    own, to, shard = unused(docs, "_own", "_to", "shard")
    moves = placed.where("old <> shard")
    touched = moves.select(c("shard").alias(shard)).union(moves.select(c("old").alias(shard))).distinct()
    # One row per shard: a number that the caller chose, not one that grows with the data.
    names = F.broadcast(touched)
    target = placed.groupBy(c("key").alias(to)).agg(F.min("shard").alias(shard)).join(names, shard)
    docs.withColumn(own, key).join(target, c(own).eqNullSafe(c(to))).drop(own, to).write.partitionBy(shard).mode("overwrite").parquet(path)
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path).groupBy(c(shard).alias("shard")).agg(F.count(F.lit(1)).alias("docs"))


def layout(docs: DataFrame, key: Column, placed: DataFrame, path: str) -> DataFrame:
    """All documents as they lie after ``rewrite`` to ``path``: its files, and from the old ones the shards that nothing touches.

    The columns of ``docs`` and, behind them, the shard.
    """
    to, shard = unused(docs, "_to", "shard")
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType())])
    written = docs.sparkSession.read.schema(schema).parquet(path)
    ends = placed.groupBy("old", "shard").count().select("old", "shard").collect()  # at most one row per two shards
    touched = {x for old, new in ends if old != new for x in (old, new)}
    kept = sorted({new for _, new in ends} - touched)
    if not kept:
        return written
    still = placed.groupBy(c("key").alias(to)).agg(F.min("shard").alias(shard)).where(c(shard).isin(kept))
    return written.unionByName(docs.join(still, key.eqNullSafe(c(to))).select(*docs.columns, shard))
