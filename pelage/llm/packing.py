"""Packing of tokenized documents into sequences by vector best fit.

A piece asks for tokens, one document place and attention cost (its length
squared); a sequence has a capacity of each. Pieces are taken longest first;
among the open sequences that can take one under every constraint, the one
with the least weighted norm of what would remain is chosen (or the largest
weighted dot product of demand and room).

A piece's demand follows from its length alone, so the packing is solved on
the counts per length, a table of at most ``max_tokens`` rows: equal pieces go
into equal sequences in one step. The plan says which ranks of a length go to
which sequences, and every piece finds its place by its rank, in parallel.

Cases: a NULL text is empty and gives the end token alone; a text longer than
a sequence is cut so that only its first piece may be shorter; repeated rows
are packed one by one; NULL ids are kept; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelage.llm.hashing import slices
from pelage.llm.storage import stored

c = F.col

BLOCK_ROWS = 2_000


class TextIds:
    """Token ids (little-endian bytes) of texts, by the vocabulary file of ``tokenizers`` at ``path``.

    With ``ranks``, the same vocabulary as ``(rank file, split pattern)`` for
    ``tiktoken``, texts are encoded by that, several times as fast and to the
    same ids; a text that its pattern gives up on goes to the first again, as
    does one that holds an added token of the vocabulary, which stays one id.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(token in text for token in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:
                if type(error).__name__ != "PanicException":
                    raise
        return self.tokenizer.encode(text, add_special_tokens=False).ids


# Text whose pieces leave a task at once.
PART_CHARS = 4 << 20


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: tuple[str, str] | None, end_id: int, size: int,
            with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = TextIds(path, ranks)
    end = np.array([end_id], "<u4").tobytes()
    for part in slices(batches, "text", PART_CHARS):
        rows = []
        for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
            ids = encode(text or "") + end
            n = len(ids) // 4
            start, stop = 0, n - (n - 1) // size * size
            for piece in range((n - 1) // size + 1):
                own = ids[4 * start:4 * stop]
                rows.append((doc, piece, start, stop - start, zlib.crc32(own), own if with_ids else None))
                start, stop = stop, stop + size
        names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, size: int,
              ranks: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32, ids``; ``ids`` (packed) only where asked for."""
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda b: _pieces(b, path, ranks, end_id, size, with_ids),
                            "id long, piece int, start long, length long, ids_crc32 long, ids binary")


@dataclass
class _Group:
    """Equal sequences: how many, room left (tokens, documents, cost), and the lengths inside."""

    count: int
    room: tuple[int, int, int]
    lengths: list[tuple[int, int]]


@dataclass
class Capacity:
    tokens: int = 1024
    docs: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(counts: dict[int, int], capacity: Capacity) -> list[_Group]:
    """Groups of equal sequences that hold ``counts[length]`` pieces of each length.

    Equal pieces fill the best sequence before they go to the next one, so a
    step handles a whole group and splits off at most two.
    """
    limit = np.array([capacity.tokens, capacity.docs, capacity.cost], float)
    weights = np.array(capacity.weights)
    groups: list[_Group] = []
    rooms = np.zeros((0, 3))

    def add(group: _Group) -> None:
        nonlocal rooms
        groups.append(group)
        if len(groups) > len(rooms):
            rooms = np.concatenate([rooms, np.full((max(256, len(rooms)), 3), -1.0)])
        rooms[len(groups) - 1] = group.room

    def fill(base: _Group, length: int, copies: int, sequences: int) -> None:
        t, d, e = base.room
        lengths = base.lengths + [(length, copies)] if copies else base.lengths
        if sequences:
            add(_Group(sequences, (t - copies * length, d - copies, e - copies * length * length), lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        demand = np.array([length, 1, length * length], float)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while left:
            fits = np.flatnonzero((rooms[:len(groups)] >= demand).all(1))
            if len(fits):
                room = rooms[fits]
                if capacity.rule == "norm":
                    score = -(weights * ((room - demand) / limit) ** 2).sum(1)
                else:
                    score = (weights * (room / limit) * (demand / limit)).sum(1)
                at = int(fits[score.argmax()])
                base = groups[at]
            else:
                base = _Group(left, (capacity.tokens, capacity.docs, capacity.cost), [])
                at = None
            copies = min(int(min(r // x for r, x in zip(base.room, (length, 1, length * length)))), left)
            full = min(base.count, left // copies)
            rest = min(left - full * copies, copies) if full < base.count else 0
            fill(base, length, copies, full)
            fill(base, length, rest, 1 if rest else 0)
            left -= full * copies + rest
            if at is not None:
                unused = base.count - full - (1 if rest else 0)
                groups[at] = _Group(unused, base.room, base.lengths)
                if not unused:
                    rooms[at] = -1
    return [g for g in groups if g.count]


def plan(groups: list[_Group]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, from_rank, to_rank, first_sequence, copies, offset`` of every length of every group."""
    rows, taken, sequence = [], {}, 0
    for group in groups:
        offset = 0
        for length, copies in group.lengths:
            low = taken.get(length, 0)
            taken[length] = low + group.count * copies
            rows.append((length, low, taken[length], sequence, copies, offset))
            offset += length * copies
        sequence += group.count
    return rows


def packed(pieces: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces need a ``length``.

    The driver sees the histogram of lengths, at most ``capacity.tokens`` rows.
    """
    spark = pieces.sparkSession
    rows = stored(pieces, "packing-pieces")
    counts = {row["length"]: row["n"] for row in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(best_fit(counts, capacity))
    blocks = spark.createDataFrame([(n, -(-k // BLOCK_ROWS)) for n, k in counts.items()], "length long, blocks int")
    # Both tables follow from the lengths a sequence can hold, not from the number of pieces.
    keyed = rows.join(F.broadcast(blocks), "length").withColumn(
        "block", F.pmod(F.xxhash64(*order), c("blocks")).cast("int")).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy(*order)
    ranked = keyed.join(starts, ["length", "block"]).withColumn("rank", c("before") + F.row_number().over(within) - 1)
    table = spark.createDataFrame(places, "of long, low long, high long, first long, copies long, base long")
    placed = ranked.join(F.broadcast(table), (c("length") == c("of")) & (c("rank") >= c("low")) & (c("rank") < c("high")))
    nth = c("rank") - c("low")
    return placed.select(
        *rows.columns, (c("first") + F.floor(nth / c("copies"))).cast("long").alias("sequence_id"),
        (c("base") + F.pmod(nth, c("copies")) * c("length")).cast("long").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed token ids of every sequence, for pieces tokenized with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"])).alias("ids"))
