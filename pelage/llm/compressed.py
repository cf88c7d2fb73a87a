"""Texts that have to pass a shuffle travel compressed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.hashing import SLICE_BYTES


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            packed = [press.compress(v.as_buffer()) if v.is_valid else b"" for v in part.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "packed": pa.array(packed, pa.binary())})


def compressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, packed`` of every row; a NULL text packs to nothing."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _compress, "id long, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in slices of at most about ``limit`` bytes of text, with the texts."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        texts: list[bytes] = []
        first = held = 0
        for row, value in enumerate(batch.column("packed")):
            packed = value.as_buffer()
            texts.append(press.decompress(packed) if packed.size else b"")
            held += len(texts[-1])
            if held >= limit:
                yield batch.slice(first, row + 1 - first), texts
                texts, first, held = [], row + 1, 0
        if texts:
            yield batch.slice(first), texts
