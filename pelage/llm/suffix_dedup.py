"""Suffix-array dedup of bytes by blockwise difference-cover sorting.

A byte goes when a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Every such string has a pin, its least ``k``-byte
gram, wherever it stands; strings in a row with the same pin form a context.

1. Only pins that two documents share can matter (``shared_keys``).
2. A context whose whole content stands in a smaller document is settled as one.
3. The other contexts go to blocks by pin, so equal strings meet in a block.
   The block's suffixes are sorted bucket by bucket with difference-cover
   ranks (``suffix_blocks``) and neighbours compared byte by byte.
4. Contexts of a pin that very many documents continue differently would fill
   a block; their strings are looked up by hash instead, spread evenly.

Cases: a NULL text is empty; texts shorter than ``length`` keep all bytes;
rows that share an id are one document and never match each other; rows with a
NULL id match nothing; an empty table gives an empty result; further columns
are not looked at. Steps 2 and 4 rest on 64-bit hashes, step 3 on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.compressed import compressed, unpacked
from pelage.llm.hashing import (
    U64, Bytes, key_lists, least_grams, member, mix, pack, slices, spans, text_bytes, unpack,
)
from pelage.llm.shared_keys import shared_keys
from pelage.llm.storage import stored
from pelage.llm.suffix_blocks import repeated_elsewhere

c = F.col

# Contexts of one pin that a block takes; a text block is cut at the next pin after so many bytes, and texts are
# looked at so many bytes at a time: their 8-byte columns stay in a core's cache.
HOT_CONTEXTS = 20_000
BLOCK_BYTES = 1 << 18
SLICE_BYTES = 1 << 17


def _runs(b: Bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes in a row with the same pin: (first start, number of strings, text number, pin hash)
    of each run, and the prefix sums."""
    n = len(b.data)
    sums = b.hashed()
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), sums
    sizes = np.diff(b.offsets)
    least, pin = least_grams(sums, k, length - k + 1, np.arange(n) - np.repeat(b.offsets[:-1], sizes))
    # A string must end where its text does at the latest.
    step = np.zeros(n + 1, np.int8)
    long_ = sizes >= length
    step[b.offsets[:-1][long_]] += 1
    step[b.offsets[1:][long_] - length + 1] -= 1
    valid = np.cumsum(step[:len(pin)], dtype=np.int8) > 0
    head = valid.copy()
    head[1:] &= (pin[1:] != pin[:-1]) | ~valid[:-1]
    start = np.flatnonzero(head)
    count = np.cumsum(valid)
    return (start, np.diff(np.r_[count[start], count[-1] + 1]), np.searchsorted(b.offsets, start, "right") - 1,
            mix(least[start] >> U64(6)), sums)


def _cuts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _pins(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        _, _, doc, key, _ = _runs(text_bytes(batch.column("text")), length, k)
        cuts = _cuts(doc, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"owner": batch.column("id"), "keys": pa.array(
            [pack(np.unique(key[a:b]), "<u8") for a, b in zip(cuts, cuts[1:])], pa.binary())})


class Contexts:
    """Contexts with shared pins in a slice of texts: first string, number of strings, text number, pin, content hash."""

    def __init__(self, texts: list[bytes], hits: pa.Array, length: int, k: int):
        self.bytes = Bytes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        start, n, doc, key, self.sums = _runs(self.bytes, length, k)
        # The strings of a run have one pin, so a run is shared or not as a whole.
        kept = member(key_lists(hits), doc, key)
        self.start, self.n, self.doc, self.pin = start[kept], n[kept], doc[kept], key[kept]
        self.edge = spans(self.sums, self.start, self.start + self.n + length - 1)

    def first_in_text(self) -> np.ndarray:
        """Contexts without an equal one before them in their text."""
        order = np.lexsort((self.start, self.edge, self.doc))
        same = np.zeros(len(order), bool)
        same[1:] = (self.edge[order][1:] == self.edge[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        result = np.ones(len(order), bool)
        result[order[same]] = False
        return result


def _edges(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in unpacked(batches, SLICE_BYTES):
        x = Contexts(texts, batch.column("hits"), length, k)
        cuts = _cuts(x.doc, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"owner": batch.column("id"), "keys": pa.array(
            [pack(np.unique(x.edge[a:b]), "<u8") for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _open(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Contexts that no smaller document holds, with their bytes."""
    for batch, texts in unpacked(batches, SLICE_BYTES):
        x = Contexts(texts, batch.column("hits"), length, k)
        take = x.first_in_text() & ~member(key_lists(batch.column("settled")), x.doc, x.edge)
        start, n, doc = x.start[take], x.n[take], x.doc[take]
        whole = x.bytes.data.tobytes()
        ids = np.array(batch.column("id").to_pylist(), np.int64)
        yield pa.RecordBatch.from_pydict({
            "pin": pa.array(x.pin[take].view(np.int64)), "doc": pa.array(ids[doc]),
            "edge": pa.array(x.edge[take].view(np.int64)),
            "content": pa.array([whole[a:b] for a, b in zip(start, start + n + length - 1)], pa.binary())})


def _sort_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by pin, block by block: for each context the mask of its strings that start in a smaller document."""
    def settle(docs: list[int], edges: list[int], contents: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in contents])
        text = np.frombuffer(b"".join(contents), np.uint8)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        n = sizes - length + 1
        of = np.repeat(np.arange(len(n)), n)
        starts = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        found = repeated_elsewhere(text, starts, np.array(docs, np.int64)[of], length)
        at = np.searchsorted(first, found, "right") - 1
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, at, np.int64(1) << (found - first[at]))
        hit = np.flatnonzero(mask)
        owner = np.array(docs, np.int64)[hit]
        hit = hit[np.argsort(owner, kind="stable")]
        owner = np.array(docs, np.int64)[hit]
        who, cut = np.unique(owner, return_index=True)
        edge = np.array(edges, np.int64)[hit]
        cut = np.r_[cut, len(hit)]
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(who, pa.int64()),
            "edges": pa.array([pack(edge[a:b], "<i8") for a, b in zip(cut, cut[1:])], pa.binary()),
            "masks": pa.array([pack(mask[hit[a:b]], "<i8") for a, b in zip(cut, cut[1:])], pa.binary())})

    docs: list[int] = []
    edges: list[int] = []
    contents: list[bytes] = []
    held, last = 0, None
    for batch in batches:
        for pin, doc, edge, content in zip(*[batch.column(x).to_pylist() for x in ("pin", "doc", "edge", "content")]):
            if held >= BLOCK_BYTES and pin != last:
                yield settle(docs, edges, contents)
                docs, edges, contents, held = [], [], [], 0
            docs.append(doc)
            edges.append(edge)
            contents.append(content)
            held += len(content)
            last = pin
    if contents:
        yield settle(docs, edges, contents)


def _context_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the strings of each context, as keys of its document."""
    for batch in batches:
        contents = batch.column("content").to_pylist()
        b = Bytes(np.frombuffer(b"".join(contents), np.uint8), np.cumsum([0, *map(len, contents)]))
        sums = b.hashed()
        keys = []
        for low, high in zip(b.offsets, b.offsets[1:]):
            at = np.arange(low, high - length + 1)
            keys.append(pack(np.unique(spans(sums, at, at + length)), "<u8"))
        yield pa.RecordBatch.from_pydict({"owner": batch.column("doc"), "keys": pa.array(keys, pa.binary())})


def _remove(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in unpacked(batches, SLICE_BYTES):
        x = Contexts(texts, batch.column("hits"), length, k)
        n = batch.num_rows
        mask = np.where(member(key_lists(batch.column("settled")), x.doc, x.edge), np.int64(-1), np.int64(0))
        cuts = _cuts(x.doc, n)
        for i, parts in enumerate(batch.column("sorted").to_pylist()):
            if parts and cuts[i] < cuts[i + 1]:
                edge = np.concatenate([unpack(p["edges"], "<i8") for p in parts]).view(U64)
                bits = np.concatenate([unpack(p["masks"], "<i8") for p in parts])
                order = np.argsort(edge, kind="stable")
                edge, bits = edge[order], bits[order]
                own = x.edge[cuts[i]:cuts[i + 1]]
                at = np.minimum(np.searchsorted(edge, own), len(edge) - 1)
                mask[cuts[i]:cuts[i + 1]] |= np.where(edge[at] == own, bits[at], 0)
        hot = key_lists(batch.column("hot"))
        asked = np.array([len(h) > 0 for h in hot], bool)
        # Strings are looked at one by one only in contexts that may lose some.
        some = np.flatnonzero((mask != 0) | asked[x.doc])
        of = np.repeat(some, x.n[some])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(x.n[some]) - x.n[some], x.n[some])
        start, doc = x.start[of] + nth, x.doc[of]
        gone = (mask[of] >> nth) & 1 == 1
        if asked.any():
            gone |= member(hot, doc, spans(x.sums, start, start + length))
        size = len(x.bytes.data) + 1
        cover = np.bincount(start[gone], minlength=size) - np.bincount(start[gone] + length, minlength=size)
        drop = np.cumsum(cover[:-1]) > 0
        total = np.r_[0, np.cumsum(drop)][x.bytes.offsets]
        removed = np.diff(total)
        kept, runs = [], []
        for low, high, lost in zip(x.bytes.offsets.tolist(), x.bytes.offsets[1:].tolist(), removed.tolist()):
            if not lost:
                kept.append(x.bytes.data[low:high].tobytes())
                runs.append([])
                continue
            part = drop[low:high]
            kept.append(x.bytes.data[low:high][~part].tobytes())
            edge = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8)))
            runs.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "n_bytes": pa.array(np.diff(x.bytes.offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   k: int = 20) -> DataFrame:
    """``id, n_bytes, n_removed, kept, spans``: texts without the bytes of strings that smaller documents hold.

    ``kept`` are the other bytes in order; ``spans`` the maximal removed runs (byte offsets).
    """
    if not 32 <= length <= 62:
        raise ValueError(f"strings of {length} bytes: the ranks of the suffix blocks hold for 32 to 62")
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    hits = stored(shared_keys(texts, lambda b: _pins(b, length, k)), "suffix-pins").select(
        "owner", c("keys").alias("hits"))
    packed = compressed(docs, id_col, text_col)
    with_hits = packed.join(hits, c("id") == c("owner")).select("id", "packed", "hits")
    settled = shared_keys(with_hits, lambda b: _edges(b, length, k), later=True).select(
        c("owner").alias("o"), c("keys").alias("settled"))
    known = stored(hits.join(settled, c("owner") == c("o"), "left").select("owner", "hits", "settled"), "suffix-known")
    contexts = stored(
        packed.join(known, c("id") == c("owner")).select("id", "packed", "hits", "settled").mapInArrow(
            lambda b: _open(b, length, k), "pin long, doc long, edge long, content binary"), "suffix-contexts")
    crowd = contexts.groupBy("pin").agg(F.count(F.lit(1)).alias("n"))
    # A pin of one context has nothing to compare; crowded pins are few, one per HOT_CONTEXTS contexts at most.
    alone = crowd.where("n > 1").select("pin", (c("n") > HOT_CONTEXTS).alias("crowded"))
    dealt = contexts.join(alone, "pin")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (dealt.where("NOT crowded").select("pin", "doc", "edge", "content")
               .repartition(width, "pin").sortWithinPartitions("pin")
               .mapInArrow(lambda b: _sort_blocks(b, length), "doc long, edges binary, masks binary"))
    sorted_ = sorted_.groupBy(c("doc").alias("s")).agg(F.collect_list(F.struct("edges", "masks")).alias("sorted"))
    hot = shared_keys(dealt.where("crowded").select("doc", "content"), lambda b: _context_strings(b, length),
                      later=True).select(c("owner").alias("h"), c("keys").alias("hot"))
    found = stored(sorted_.join(hot, c("s") == c("h"), "full").select(
        F.coalesce("s", "h").alias("found_id"), "sorted", "hot"), "suffix-found")
    judged = packed.join(known, c("id") == c("owner"), "left").join(found, c("id") == c("found_id"), "left")
    return judged.select("id", "packed", "hits", "settled", "sorted", "hot").mapInArrow(
        lambda b: _remove(b, length, k),
        "id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:int,end:int>>")
