"""Vectorised hashing of words, word runs and byte runs inside tasks.

Texts are taken slice by slice from Arrow buffers. A prefix sum of
``T[byte] * B**i`` modulo 2**64 gives the hash of any span by one subtraction
and one multiplication; a last mixing step spreads it over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# Text bytes that a task hashes at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``size`` places."""
    def chain(base: int) -> np.ndarray:
        out = np.full(size + 1, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return chain(_BASE), chain(_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 16, 1 << int(size).bit_length()))


def span_table(data: np.ndarray) -> np.ndarray:
    """The 64-bit item of each byte, for ``prefix``."""
    return _TABLE[data]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``spans``; ``values`` are 64-bit items in order."""
    power, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end)."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


@dataclass
class Bytes:
    """Bytes of a slice of texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def hashed(self) -> np.ndarray:
        return prefix(_TABLE[self.data])


@dataclass
class Words:
    """Words of a slice of texts in order: hash, text number, byte range; ``first[i]`` is the first word of text i."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> Bytes:
    """NULL is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return Bytes(raw, offsets - low)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(text)).offsets[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def split_words(b: Bytes, lower: bool = False) -> Words:
    """Words are runs of bytes other than the six ASCII white-space bytes."""
    data = LOWER[b.data] if lower else b.data
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = b.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= solid[edges]
    last[edges - 1] |= solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix(_TABLE[data])
    doc = np.searchsorted(b.offsets, start, "right") - 1
    return Words(spans(sums, start, end), doc, start, end,
                 np.searchsorted(start, b.offsets).astype(np.int64))


def word_runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of k words that lies in one text."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = prefix(words.hash)
    at = np.arange(n - k + 1)
    at = at[words.doc[: n - k + 1] == words.doc[k - 1:]]
    return at, spans(sums, at, at + k)


def least_grams(sums: np.ndarray, k: int, width: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` k-grams (at most 64) its least gram and that gram's place.

    The gram but for its lowest 6 bits depends on the window's content alone.
    ``within`` is each item's place in its text; of equal grams in a window it
    picks one, so a text is cut alike wherever it lies in a slice.
    """
    n = len(sums) - k  # grams
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    _, inverse = powers(len(sums))
    grams = (sums[k:] - sums[:-k]) * inverse[:n]
    grams ^= grams >> U64(32)
    grams *= U64(0xD6E8FEB86659FD93)
    grams &= U64(0xFFFFFFFFFFFFFFC0)
    grams |= (within[:n] & 63).astype(U64)
    reach = 1
    while reach < width:  # least of grams i .. i + reach - 1
        step = min(reach, width - reach)
        grams = np.minimum(grams[:-step], grams[step:])
        reach += step
    start = np.arange(len(grams))
    return grams, start + (((grams & U64(63)).view(np.int64) - within[:len(grams)]) & 63)


def pins(sums: np.ndarray, k: int, width: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each window's least gram (``least_grams``)."""
    least, place = least_grams(sums, k, width, within)
    return mix(least >> U64(6)), place


def pack(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def unpack(value, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def key_lists(column: pa.Array) -> list[np.ndarray]:
    """Packed keys of each row; NULL is none."""
    return [unpack(value.as_buffer(), "<u8") if value.is_valid else np.zeros(0, U64) for value in column]


def member(keys: list[np.ndarray], doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys of its document (documents in order)."""
    result = np.zeros(len(values), bool)
    cuts = np.searchsorted(doc, np.arange(len(keys) + 1))
    for i, own in enumerate(keys):
        if len(own) and cuts[i] < cuts[i + 1]:
            part = values[cuts[i]:cuts[i + 1]]
            at = np.minimum(np.searchsorted(own, part), len(own) - 1)
            result[cuts[i]:cuts[i + 1]] = own[at] == part
    return result
