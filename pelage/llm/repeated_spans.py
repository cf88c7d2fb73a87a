"""Substring dedup on words by a compacted De Bruijn graph.

Runs of ``window`` words are the edges of the graph (their ends share all but
one word). The least short k-mer inside a window is its pin: windows in a row
with the same pin are one compacted edge, and equal windows have equal pins
wherever they stand. Only pins that occur twice can hold a repeated window, so
everything else leaves at once. Equal compacted edges meet in a grouping that
keeps their first source coordinate; a join brings it back to every
occurrence, and occurrences whose sources follow each other are compacted to
long repeated paths. Windows that begin or end a path inside a first
occurrence are looked up one by one.

Cases: a NULL text has no words; texts shorter than a window keep all words;
rows that share an id count as the same document, each is judged alike; rows
with a NULL id are compared with themselves only; an empty table gives an
empty result; further columns are not looked at. Compacted edges are compared
by 128 bits of hash, single windows by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.compressed import compressed, unpacked
from pelage.llm.hashing import (
    U64, Bytes, Words, key_lists, member, mix, pack, pins, prefix, slices, spans, split_words, text_bytes,
)
from pelage.llm.shared_keys import shared_keys
from pelage.llm.storage import stored

c = F.col

_EDGES = "edge long, proof long, doc long, start int, n int, windows binary"


def _windows(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, pin position, pin hash, hash) of every window inside one text, in order."""
    n = len(words.hash)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    sums = prefix(words.hash)
    key, pin = pins(sums, k, window - k + 1, np.arange(n) - words.first[words.doc])
    start = np.arange(n - window + 1)
    start = start[words.doc[: n - window + 1] == words.doc[window - 1:]]
    return start, pin[start], key[start], spans(sums, start, start + window)


def _pins(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = split_words(text_bytes(batch.column("text")))
        start, pin, key, _ = _windows(words, window, k)
        first = np.ones(len(pin), bool)
        first[1:] = pin[1:] != pin[:-1]
        doc, key = words.doc[start[first]], key[first]
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_pydict({"owner": batch.column("id"), "keys": pa.array(
            [pack(key[a:b], "<u8") for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _joined(texts: list[bytes]) -> Bytes:
    return Bytes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def _compact(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Compacted edges of each document: maximal rows of windows with one repeated pin."""
    for batch, texts in unpacked(batches):
        words = split_words(_joined(texts))
        start, pin, key, hashed = _windows(words, window, k)
        kept = member(key_lists(batch.column("hits")), words.doc[start], key)
        start, pin, hashed = start[kept], pin[kept], hashed[kept]
        if not len(start):
            continue
        head = np.ones(len(start), bool)
        head[1:] = (pin[1:] != pin[:-1]) | (start[1:] != start[:-1] + 1)
        cut = np.flatnonzero(head)
        n = np.diff(np.r_[cut, len(start)])
        first = start[cut]
        end = first + n + window - 1
        doc = words.doc[first]
        ids = np.array(batch.column("id").to_pylist(), np.int64)
        offsets = pa.array(np.r_[cut, len(start)] * 8, pa.int32())
        yield pa.RecordBatch.from_pydict({
            "edge": pa.array(spans(prefix(words.hash), first, end).view(np.int64)),
            "proof": pa.array(spans(prefix(mix(words.hash ^ U64(0x5851F42D4C957F2D))), first, end).view(np.int64)),
            "doc": pa.array(ids[doc]), "start": pa.array(first - words.first[doc], pa.int32()), "n": pa.array(n, pa.int32()),
            "windows": pa.BinaryArray.from_buffers(pa.binary(), len(cut), [
                None, offsets.buffers()[1], pa.py_buffer(pack(hashed, "<u8"))])})


def _paths(spans_list: list, window: int) -> list[dict]:
    """Occurrences whose sources follow each other, compacted: word ranges with their source."""
    paths: list[dict] = []
    for s in sorted(spans_list, key=lambda s: s["start"]):
        last = paths[-1] if paths else None
        if (last and s["start"] == last["end"] - window + 1 and s["source"] == last["source"]
                and s["source_start"] - last["source_start"] == s["start"] - last["start"]):
            last["end"] = s["start"] + s["n"] + window - 1
        else:
            paths.append({"start": s["start"], "end": s["start"] + s["n"] + window - 1,
                          "source": s["source"], "source_start": s["source_start"]})
    return paths


_RESULT = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_string()),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()),
                                  ("source_start", pa.int32())])))])


def _remove(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in unpacked(batches):
        words = split_words(_joined(texts))
        start, _, _, hashed = _windows(words, window, k)
        doc = words.doc[start]
        gone = member(key_lists(batch.column("later")), doc, hashed)
        # A window that stands earlier in its own document.
        order = np.lexsort((start, hashed, doc))
        same = np.zeros(len(order), bool)
        same[1:] = (hashed[order][1:] == hashed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        gone[order[same]] = True
        size = len(words.hash) + 1
        cover = np.bincount(start[gone], minlength=size) - np.bincount(start[gone] + window, minlength=size)
        paths = []
        for i, found in enumerate(batch.column("found").to_pylist()):
            paths.append(_paths(found or [], window))
            for p in paths[-1]:
                cover[words.first[i] + p["start"]] += 1
                cover[words.first[i] + p["end"]] -= 1
        keep = np.cumsum(cover[:-1]) == 0
        kept = []
        removed = []
        for i, text in enumerate(texts):
            mask = keep[words.first[i]:words.first[i + 1]]
            kept.append(b" ".join(compress(text.split(), mask.tolist())).decode())
            removed.append(len(mask) - int(mask.sum()))
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array(np.diff(words.first)), pa.array(removed, pa.int64()),
            pa.array(kept, pa.large_string()), pa.array(paths, _RESULT.field("paths").type)], schema=_RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   k: int = 8) -> DataFrame:
    """``id, n_words, n_removed, kept, paths``: texts without the words of windows that start earlier.

    Earlier is a smaller id, or the same id and an earlier start. ``kept`` joins
    the other words by one space; ``paths`` are the long repeated spans with
    their source coordinates (in words).
    """
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    hits = shared_keys(texts, lambda b: _pins(b, window, k)).withColumnRenamed("keys", "hits")
    packed = compressed(docs, id_col, text_col)
    edges = stored(
        packed.join(hits, c("id") == c("owner")).select("id", "packed", "hits").mapInArrow(
            lambda b: _compact(b, window, k), _EDGES), "repeat-edges")
    at = F.struct("doc", "start")
    nodes = stored(
        edges.groupBy("edge", "proof").agg(F.min(F.struct("doc", "start", "windows")).alias("first")).select(
            "edge", "proof", c("first.doc").alias("source"), c("first.start").alias("source_start"),
            c("first.windows").alias("windows")), "repeat-nodes")
    # Of each compacted edge only the first occurrence still has open windows.
    later = shared_keys(nodes.select(c("source").alias("owner"), c("windows").alias("keys")), iter, later=True).select(
        c("owner").alias("later_id"), c("keys").alias("later"))
    others = (edges.drop("windows").join(nodes.drop("windows"), ["edge", "proof"])
              .where(at != F.struct("source", "source_start")))
    found = others.groupBy(c("doc").alias("found_id")).agg(
        F.collect_list(F.struct("start", "n", "source", "source_start")).alias("found"))
    judged = packed.join(found, c("id") == c("found_id"), "left").join(later, c("id") == c("later_id"), "left")
    return judged.select("id", "packed", "found", "later").mapInArrow(
        lambda b: _remove(b, window, k),
        "id long, n_words long, n_removed long, kept string, "
        "paths array<struct<start:int,end:int,source:long,source_start:int>>")
