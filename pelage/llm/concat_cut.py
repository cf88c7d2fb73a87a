"""Packing by concatenation: all documents form one stream of tokens, which is cut into fixed windows.

The first pass turns texts into ids, partition by partition, and writes them
with the number of tokens before each document in its partition. The totals of
the partitions are summed twice, within blocks of partitions and over the
blocks, which gives every partition its place in the stream. The second pass
adds that place and cuts each document where a window ends. A document that
crosses an edge leaves a boundary record: the piece that goes on in the next
window. Nothing is sorted or shuffled but the totals, one row per partition.

The last window is short. It is padded, or with ``tail="powers"`` cut at the
binary digits of its length into windows whose lengths are powers of two, for
users who train those without padding.

Cases: a NULL text is empty and gives the end token alone; a long text spans as
many windows as it needs; repeated rows and rows with NULL ids are documents of
their own; an empty table gives an empty result; further columns are not
looked at. The order of the stream is the order in which the table is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelage.llm.hashing import slices, text_bytes
from pelage.llm.storage import stored

c = F.col

# Text and ids that leave a task at once.
PART_BYTES = 4 << 20
# Runs of text whose ids a task remembers.
KNOWN_RUNS = 400_000
# Partitions whose totals are summed by one task of the prefix sum.
BLOCK_PARTS = 1024
# A broadcast row of the partitions' places takes some 50 bytes.
BROADCAST_PARTS = 1_000_000


# Printable ASCII and the letters of Latin-1: lower-casing and composition change their characters one by one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# The pieces that word_bpe_49k.json cuts lower-cased text into, for those characters.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_END = b"\x00"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RunIds:
    """Ids of texts by way of their runs of UTF-8 bytes without ASCII white space.

    For vocabularies that never join text across white space and drop it: the
    ids of a text are those of its runs, one after the other, so a run is
    encoded once and remembered. What is remembered is bounded: beyond
    ``KNOWN_RUNS`` only the runs of the last batch stay.

    ``word_ends`` is for vocabularies that mark the end of a word, cut as in
    ``_PIECES``: new runs of plain characters are then encoded together by the
    same merges in ``tiktoken``, a zero byte standing for the end of a word.
    All other runs go to ``tokenizers`` as loaded.
    """

    def __init__(self, path: str, kind: str, word_ends: str | None = "</w>"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.known: dict[bytes, bytes] = {}
        self.fast = None
        if word_ends:
            self._load(path, word_ends)

    def _load(self, path: str, word_ends: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of, vocabulary = _byte_of(), model["vocab"]

        def packed(token: str) -> bytes:
            word = token.removesuffix(word_ends)
            return bytes(byte_of[x] for x in word) + (_END if word != token else b"")

        # Single bytes, then bytes at a word's end, so that the end is joined first, then the merges in their order.
        single = sorted(byte_of, key=byte_of.get)
        order = single + [x + word_ends for x in single]
        order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks = {packed(token): rank for rank, token in enumerate(order)}
        self.fast = tiktoken.Encoding("word-ends", pat_str="[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array([vocabulary[token] for token in order], self.kind)
        self.ends = np.array([token.endswith(word_ends) for token in order])

    def encode(self, data: bytes) -> bytes:
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, runs: set[bytes]) -> None:
        plain, pieces, counts = [], [], []
        for run in runs:
            text = run.decode()
            if self.fast is not None and _PLAIN.fullmatch(text) and "<|" not in text:
                own = _PIECES.findall(text.lower())
                plain.append(run)
                pieces += own
                counts.append(len(own))
            else:
                self.known[run] = self.encode(run)
        if plain:
            ranks = np.array(self.fast.encode_ordinary("\x00".join(pieces) + "\x00"))
            ends = (np.flatnonzero(self.ends[ranks]) + 1)[np.cumsum(counts) - 1]
            ids, width = self.ids[ranks].tobytes(), self.ids.itemsize
            start = 0
            for run, end in zip(plain, (ends * width).tolist()):
                self.known[run] = ids[start:end]
                start = end

    def texts(self, texts: list[bytes]) -> list[bytes]:
        runs = [text.split() for text in texts]
        own = set(chain.from_iterable(runs))
        if len(self.known) > KNOWN_RUNS:
            self.known = {run: self.known[run] for run in own if run in self.known}
        self._learn(own.difference(self.known))
        return [b"".join(map(self.known.__getitem__, x)) for x in runs]


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, word_ends: str | None, kind: str) -> Iterator[pa.RecordBatch]:
    known = RunIds(path, kind, word_ends)
    end = np.array([end_id], kind).tobytes()
    part = TaskContext.get().partitionId()
    before = 0
    for batch in slices(batches, "text", PART_BYTES):
        texts = text_bytes(batch.column("text"))
        data = texts.data.tobytes()
        ids = [x + end for x in known.texts([data[a:b] for a, b in zip(texts.offsets[:-1], texts.offsets[1:])])]
        tokens = np.array([len(x) for x in ids], np.int64) // len(end)
        ends = before + np.cumsum(tokens)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(len(ids), part, np.int32)), "before": pa.array(ends - tokens),
            "id": batch.column("id"), "tokens": pa.array(tokens), "ids": pa.array(ids, pa.binary())})
        before = int(ends[-1])


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, word_ends: str | None = "</w>",
              kind: str = "<u2") -> DataFrame:
    """First pass, written: ``part, before, id, tokens, ids`` with ids packed as ``kind``.

    Both totals and pieces come from what is written, so a task that runs again
    cannot shift the stream.
    """
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(lambda b: _tokenize(b, path, end_id, word_ends, kind),
                                   "part int, before long, id long, tokens long, ids binary"), "stream-tokens")


def part_offsets(rows: DataFrame) -> DataFrame:
    """``part, parts_before``: tokens in all partitions before this one."""
    totals = rows.groupBy("part").agg(F.max(c("before") + c("tokens")).alias("total")).withColumn(
        "block", F.floor(c("part") / BLOCK_PARTS).cast("int"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of partitions.
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total")).select(
        c("block").alias("of_block"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("blocks_before"))
    within = totals.select("part", "block", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("in_block"))
    return within.join(blocks, c("block") == c("of_block")).select(
        "part", (c("in_block") + c("blocks_before")).cast("long").alias("parts_before"))


def edges(total: int, size: int, tail: str) -> np.ndarray:
    """Starts of the windows from the last whole one on, and the end of the stream."""
    whole, rest = divmod(total, size)
    if tail == "pad":
        lengths = [rest] if rest else []
    elif tail == "powers":
        lengths = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    else:
        raise ValueError(f"tail is 'pad' or 'powers', not {tail!r}")
    return whole * size + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], size: int, last: np.ndarray, kind: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    width = np.dtype(kind).itemsize
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    for batch in batches:
        begin = np.asarray(batch.column("parts_before")) + np.asarray(batch.column("before"))
        tokens = np.asarray(batch.column("tokens"))
        rows = []
        for doc, at, n, ids in zip(batch.column("id").to_pylist(), begin.tolist(), tokens.tolist(), batch.column("ids")):
            own, start = np.frombuffer(ids.as_buffer(), kind), 0
            while start < n:
                if at + start < last[0]:
                    sequence = (at + start) // size
                    first, stop = sequence * size, (sequence + 1) * size
                else:
                    nth = int(np.searchsorted(last, at + start, "right")) - 1
                    sequence, first, stop = int(last[0]) // size + nth, int(last[nth]), int(last[nth + 1])
                length = min(n, stop - at) - start
                words = own[start:start + length].astype("<u4").tobytes()
                rows.append((doc, start, length, zlib.crc32(words), n, sequence, at + start - first, words if with_ids else None))
                start += length
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def pieces(rows: DataFrame, size: int, tail: str = "pad", kind: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Second pass over ``tokenized`` rows: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` (packed as ``<u4``) only where asked for. The driver sees the
    number of partitions and of tokens.
    """
    offsets = stored(part_offsets(rows), "stream-offsets")
    seen = rows.agg(F.sum("tokens").alias("tokens")).first()
    last = edges(seen["tokens"] or 0, size, tail)
    placed = rows.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_PARTS else offsets, "part").select(
        "id", "before", "parts_before", "tokens", "ids")
    return placed.mapInArrow(
        lambda b: _cut(b, size, last, kind, with_ids),
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def boundaries(cut: DataFrame) -> DataFrame:
    """One record for each window that begins inside a document: the document and its tokens on both sides."""
    return cut.where(c("start") > 0).select(
        "sequence_id", "id", c("start").alias("tokens_before"), (c("doc_tokens") - c("start")).alias("tokens_after"))
