"""Importance resampling towards a target distribution over hashed n-grams.

Texts are taken batch by batch. A batch's texts are joined with a separator
behind each, one regular expression finds all words and separators in order,
and the places of the separators are the offsets of the documents among them.
A search of every place in the offsets gives its document, n-grams whose first
and last word differ in that are masked, and the rest is counted per bucket.

A first pass counts the buckets over all documents and over the target texts; a
bucket's gain is the smoothed log ratio of the two. A second pass gives each
document the mean gain of its features. Documents are drawn by the greatest
weight plus Gumbel noise that a hash of the id decides, so the draw does not
depend on partitions. The counts per score, whose number is bounded by the
range of weights and noise, give the cut and the first rank of every score;
within a score, documents are numbered by id.

Cases: a NULL or empty text has no features and weight zero; documents below
``min_words`` get a score but are not drawn; a NULL id has no score, is not
drawn and is not counted among those to draw from; repeated rows count each and
are ranked next to each other; an empty table gives an empty result, no target
texts gains by the smoothing alone; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelage.llm.hashing import slices, text_bytes
from pelage.llm.storage import stored

c = F.col

# Text of a batch that is joined at once.
BATCH_BYTES = 2 << 20
# Words whose bucket a task remembers.
KNOWN_WORDS = 400_000
SEPARATOR = b"\x00"
# Digits, lower-case letters and all bytes of letters beyond ASCII; or a separator.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``longest`` words, each in one of ``buckets`` buckets by crc32."""

    longest: int = 1
    buckets: int = 10_000


class _Buckets(dict):
    """Bucket of a word, remembered; the separator has none."""

    def __init__(self, buckets: int):
        super().__init__({SEPARATOR: -1})
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
            self[SEPARATOR] = -1
        bucket = self[word] = zlib.crc32(word) % self.buckets
        return bucket


def batch_features(texts: pa.Array, shape: Features, known: _Buckets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 on: (document number, bucket) of all runs of n words of the batch."""
    held = text_bytes(texts)
    data, ends = held.data, held.offsets[1:]
    # A zero byte inside a text parts words as any other ASCII byte does.
    joined = np.insert(np.where(data == 0, np.uint8(32), data), ends, 0).tobytes().lower()
    tokens = TOKEN.findall(joined)
    codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    offsets = np.flatnonzero(codes < 0)
    at = np.flatnonzero(codes >= 0)
    doc = np.searchsorted(offsets, np.arange(len(tokens)))
    yield doc[at], codes[at]
    sums: list[int] = []
    for n in range(2, shape.longest + 1):
        # Sums of the runs that go on within their document, one word longer each time.
        if n == 2:
            sums = [zlib.crc32(word) for word in tokens]
        whole = np.zeros(len(tokens), bool)
        last = len(tokens) - n + 1
        if last > 0:
            whole[:last] = (doc[:last] == doc[n - 1:]) & (codes[:last] >= 0) & (codes[n - 1:] >= 0)
        runs = np.flatnonzero(whole)
        for i in runs.tolist():
            sums[i] = zlib.crc32(tokens[i + n - 1], zlib.crc32(b" ", sums[i]))
        yield doc[runs], np.array([sums[i] % shape.buckets for i in runs.tolist()], np.int64)


def _count(batches: Iterator[pa.RecordBatch], shape: Features) -> Iterator[pa.RecordBatch]:
    """Counts per bucket, once per task."""
    total, known = np.zeros(shape.buckets, np.int64), _Buckets(shape.buckets)
    for part in slices(batches, "text", BATCH_BYTES):
        for _, bucket in batch_features(part.column("text"), shape, known):
            total += np.bincount(bucket, minlength=shape.buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})


def bucket_counts(texts: DataFrame, text_col: str, shape: Features) -> np.ndarray:
    """Features of all texts per bucket; the driver gets one number per bucket."""
    parts = texts.select(c(text_col).cast("string").alias("text")).mapInArrow(lambda b: _count(b, shape), "bucket int, n long")
    counts = np.zeros(shape.buckets, np.int64)
    for row in stored(parts.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-counts").collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floor of 1000 times the log of target share by raw share, both raised by one count per bucket."""
    k, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + k) / ((s + 1.0) * (all_target + k))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], shape: Features, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = _Buckets(shape.buckets)
    for part in slices(batches, "text", BATCH_BYTES):
        rows = part.num_rows
        words, features, sums = None, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for doc, bucket in batch_features(part.column("text"), shape, known):
            n = np.bincount(doc, minlength=rows)
            words = n if words is None else words
            features += n
            # Integer sums per document: those of all features up to its last one, less those before.
            upto = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(n)
            sums += upto[ends] - upto[ends - n]
        yield pa.RecordBatch.from_pydict({
            "id": part.column("id"), "n_words": pa.array(words), "n_features": pa.array(features),
            "weight": pa.array(np.where(features > 0, sums // np.maximum(features, 1), 0))})


def weights(docs: DataFrame, id_col: str, text_col: str, target: DataFrame, target_col: str, shape: Features = Features()) -> DataFrame:
    """``id, n_words, n_features, weight`` of every row, written."""
    gain = gains(bucket_counts(docs, text_col, shape), bucket_counts(target, target_col, shape))
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    return stored(texts.mapInArrow(lambda b: _weigh(b, shape, gain), "id long, n_words long, n_features long, weight long"), "weights")


def scored(weighted: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: weight plus Gumbel noise from the first 32 bits of the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c("id").cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(share)))
    return weighted.withColumn("score", (c("weight") + noise).cast("long"))


def drawn(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) to the ``percent`` of eligible rows with the highest scores, ties to the smaller id.

    The driver gets one count per score; scores are weights in thousandths of
    a logarithm plus noise between -3,200 and 23,000.
    """
    spark = rows.sparkSession
    eligible = F.coalesce(c("n_words") >= min_words, F.lit(False)) & c("score").isNotNull()
    counts = sorted(((r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(
        F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    ahead, reached = [], 0
    for score, n in counts:
        if reached >= wanted:
            break
        ahead.append((score, reached))
        reached += n
    # One row per score; the noise alone spreads equal weights over thousands of scores.
    table = F.broadcast(spark.createDataFrame(ahead, "at long, ahead long"))
    placed = rows.join(table, eligible & (c("score") == c("at")), "left")
    within = Window.partitionBy("score").orderBy("id", "n_features", "weight")
    reach = placed.where(c("at").isNotNull()).withColumn("rank", (c("ahead") + F.row_number().over(within)).cast("long"))
    ranked = reach.withColumn("rank", F.when(c("rank") <= wanted, c("rank")))
    rest = placed.where(c("at").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("at", "ahead")
