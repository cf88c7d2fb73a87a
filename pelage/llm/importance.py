"""Quality classifier by importance resampling.

Two bag-of-n-gram models with hashed buckets are counted: one over the target
documents, one over all raw documents. A document's importance weight is the
ratio of its likelihoods, as geometric mean per n-gram (so that length alone
does not decide) and tempered by ``TEMPERATURE``; adding Gumbel noise to the
log weights and taking the k largest draws k documents without replacement in
proportion to the weights. By default k is the number of documents whose ratio
lies above the threshold that parts labelled targets and labelled rejects best.

A document is weighted by models from which its own n-grams are taken out, so
that a text of the fitting sample and any other one are judged alike also in a
small corpus. The target count of a bucket is compared with the count that the
raw model expects there, both raised by the same pseudo count, so an n-gram
that is rarely expected says little.

With ``reject_toxic`` a second pair of models decides on toxic texts: in how
many labelled toxic and labelled harmless documents each n-gram occurs. The log
ratios of the telling n-grams of a text (those whose counts chance explains at
odds of one in ``TOXIC_BUCKETS`` at most) are summed, not averaged, so a few
words decide in a text of any length. Texts above the cut that parts the
labelled ones best have weight zero and are not drawn.

Tokens are runs of letters, digits and bytes above ASCII, or of other signs;
n-grams are single tokens and pairs. The target model and the threshold are
fitted on bounded samples of labelled documents (``FIT_ROWS`` targets and as
many rejects, by a hash of the id); the raw model, the weights, k and the cut
cover every document.

Cases: a NULL or empty text has no n-grams and log ratio 0; repeated rows are
counted, weighted and decided one by one but share the noise of their id, also
a NULL one; keys equal to the k-th are all kept; labels that contradict each
other make a document no target; without labels no document is a target and
none is kept; without toxic or without harmless labels, or with too few for
any telling n-gram, no document counts as toxic; labels that contradict each
other are toxic; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelage.llm.hashing import (
    SLICE_BYTES, U64, Bytes, Words, prefix, slices, span_table, spans, text_bytes, word_runs,
)
from pelage.llm.storage import give_back, released, small_batches, stored

c = F.col

FIT_ROWS = 20_000
BUCKETS = 1 << 16
# Observations by which a bucket's ratio is drawn towards one: few counts say little.
PSEUDO = 50.0
# Buckets of the toxic models, a multiple of BUCKETS: a few words decide, so they should not share theirs with others.
TOXIC_BUCKETS = 1 << 20
# Log odds from which an n-gram tells: by chance about one of all buckets gets there.
EVIDENCE = float(np.log(TOXIC_BUCKETS))
# Documents added to both sides of a telling n-gram's ratio.
TOXIC_PSEUDO = 0.5
SEED = 11
TEMPERATURE = 0.01
# Histogram rows per pass of the search for the k-th key.
BINS = 1 << 14

# Byte classes, 0 white space, 1 letters, digits and bytes above ASCII, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_low:_high] = 1


def tokens(b: Bytes) -> Words:
    kind = _CLASS[b.data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[b.offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    sums = prefix(span_table(b.data))
    return Words(spans(sums, start, end), np.searchsorted(b.offsets, start, "right") - 1, start, end,
                 np.searchsorted(start, b.offsets))


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram."""
    words = tokens(text_bytes(texts))
    at, pairs = word_runs(words, 2)
    bucket = lambda h: (h >> U64(17)).astype(np.int64) % buckets
    return np.concatenate([words.doc, words.doc[at]]), np.concatenate([bucket(words.hash), bucket(pairs)])


@released
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        doc, bucket = features(batch.column("text"))
        chosen = np.asarray(batch.column("target").fill_null(False).cast(pa.int8())).astype(bool)
        raw += np.bincount(bucket, minlength=BUCKETS)
        target += np.bincount(bucket[chosen[doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(at, pa.int32()), "raw": pa.array(raw[at]), "target": pa.array(target[at])})


@released
def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per n-gram bucket and side, each once; bucket -1 counts all of them."""
    sides, total = np.zeros((2, TOXIC_BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in slices(batches, "text"):
        doc, bucket = features(batch.column("text"), TOXIC_BUCKETS)
        toxic = np.asarray(batch.column("toxic").cast(pa.int8())).astype(bool)
        cell = np.unique(doc * TOXIC_BUCKETS + bucket)
        doc, bucket = cell // TOXIC_BUCKETS, cell % TOXIC_BUCKETS
        for side, chosen in enumerate((~toxic, toxic)):
            sides[side] += np.bincount(bucket[chosen[doc]], minlength=TOXIC_BUCKETS)
            total[side] += chosen.sum()
    at = np.flatnonzero(sides.sum(0))
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(np.r_[-1, at], pa.int32()), "harmless": pa.array(np.r_[total[0], sides[0, at]]),
        "toxic": pa.array(np.r_[total[1], sides[1, at]])})


def evidence(toxic: np.ndarray, harmless: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of the toxic share among the documents with an n-gram against the overall share; 0 from below."""
    n = np.maximum(toxic + harmless, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = (np.where(k > 0, k * np.log(k / (n * of)), 0) for k, of in ((toxic, share), (harmless, 1 - share)))
        return np.where(toxic > n * share, sum(parts), 0)


class ToxicModels:
    """Documents of both sides per bucket that may tell, and the ids of both fitting samples."""

    def __init__(self, counts: pa.Table, toxic_ids: np.ndarray, harmless_ids: np.ndarray):
        bucket, toxic, harmless = (np.asarray(counts.column(k)) for k in ("bucket", "toxic", "harmless"))
        self.total = np.array([harmless[bucket < 0].sum(), toxic[bucket < 0].sum()])
        share = self.total[1] / max(self.total.sum(), 1)
        # A harmless document is judged without itself, so one less may do.
        near = (bucket >= 0) & ((evidence(toxic, harmless, share) >= EVIDENCE)
                                | (evidence(toxic, np.maximum(harmless - 1, 0), share) >= EVIDENCE - 1))
        order = np.argsort(bucket[near])
        self.bucket, self.toxic, self.harmless = (x[near][order] for x in (bucket, toxic, harmless))
        self.ids = np.sort(harmless_ids), np.sort(toxic_ids)

    def scores(self, ids: pa.Array, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Sum of the log ratios of the telling n-grams of each text, each once, the text itself left out of the counts."""
        n = len(ids)
        if not len(self.bucket):
            return np.zeros(n)
        inside = np.isin(bucket, self.bucket)
        cell = np.unique(doc[inside] * TOXIC_BUCKETS + bucket[inside])
        doc, at = cell // TOXIC_BUCKETS, np.searchsorted(self.bucket, cell % TOXIC_BUCKETS)
        keys, valid = np.asarray(ids.fill_null(-1)), np.asarray(ids.is_valid())
        own = [(np.isin(keys, side) & valid)[doc] for side in self.ids]
        harmless, toxic = self.harmless[at] - own[0], self.toxic[at] - own[1]
        of_harmless, of_toxic = self.total[0] - own[0], self.total[1] - own[1]
        telling = evidence(toxic, harmless, of_toxic / np.maximum(of_harmless + of_toxic, 1)) >= EVIDENCE
        ratio = np.log((toxic + TOXIC_PSEUDO) / (harmless / np.maximum(of_harmless, 1) * of_toxic + TOXIC_PSEUDO))
        return np.bincount(doc, weights=np.where(telling, ratio, 0), minlength=n)


class Models:
    """Counts per bucket over all documents and over the targets, and the ids of the targets."""

    def __init__(self, counts: pa.Table, target_ids: np.ndarray):
        self.raw, self.target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        bucket = np.asarray(counts.column("bucket"))
        self.raw[bucket], self.target[bucket] = np.asarray(counts.column("raw")), np.asarray(counts.column("target"))
        self.ids = np.sort(target_ids)

    def log_weights(self, ids: pa.Array, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Mean log of target over raw likelihood per n-gram of each text, its own counts left out."""
        n = len(ids)
        cell, own = np.unique(doc * BUCKETS + bucket, return_counts=True)
        doc, bucket = cell // BUCKETS, cell % BUCKETS
        size = np.bincount(doc, weights=own, minlength=n)
        known = np.isin(np.asarray(ids.fill_null(-1)), self.ids) & np.asarray(ids.is_valid())

        def left_out(counts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inside = inside[doc]
            total = np.maximum(counts.sum() - np.where(inside, size[doc], 0), 1)
            return np.maximum(counts[bucket] - np.where(inside, own, 0), 0), total

        target, of = left_out(self.target, known)
        raw, all_of = left_out(self.raw, np.ones(n, bool))
        parts = own * (np.log(target + PSEUDO) - np.log(raw / all_of * of + PSEUDO))
        return np.bincount(doc, weights=parts, minlength=n) / np.maximum(size, 1)


# Labelled documents of each fitting sample: of good quality and not toxic, of bad quality, toxic, harmless.
SAMPLES = {"targets": "worst = 1 AND coalesce(harm, 0) = 0", "rejects": "best = 0", "toxic": "harm = 1", "harmless": "harm = 0"}


def fitting_samples(labels: DataFrame, names: list[str], id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Ids of each named sample, at most ``FIT_ROWS`` by a hash of the id, drawn once and held by the driver."""
    judged = stored(_judged(labels, id_col), "importance-judged")
    return {name: _drawn(judged.where(SAMPLES[name])) for name in names}


def _judged(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where(c(id_col).isNotNull()).groupBy(c(id_col).cast("long").alias("labelled_id")).agg(
        F.min("quality").alias("worst"), F.max("quality").alias("best"), F.max("toxic").alias("harm"))


def _drawn(rows: DataFrame) -> np.ndarray:
    drawn = rows.select("labelled_id").orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(FIT_ROWS)
    return np.asarray(drawn.toArrow().column("labelled_id"), np.int64)


def _sides(spark: SparkSession, samples: list[np.ndarray]) -> DataFrame:
    """``labelled_id, side``: the ids of the samples with the sample's number; small enough to go to all executors."""
    side = np.repeat(np.arange(len(samples), dtype=np.int32), [len(ids) for ids in samples])
    table = pa.table({"labelled_id": pa.array(np.concatenate(samples), pa.int64()), "side": pa.array(side)})
    return F.broadcast(spark.createDataFrame(table, "labelled_id long, side int"))


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Midpoint of the gap at which the share of good above plus the share of bad below is largest."""
    if not len(good):
        return float("inf")
    if not len(bad):
        return float(np.min(good))
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.r_[values[0] - 1, (values[1:] + values[:-1]) / 2]
    above = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    below = np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmax(above + below)])


def fit(docs: DataFrame, targets: np.ndarray, id_col: str, text_col: str) -> Models:
    """The driver gets one row of counts per bucket; it has the ids of the fitting sample."""
    rows = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    marked = rows.join(_sides(docs.sparkSession, [targets]), c("id") == c("labelled_id"), "left").select(
        "text", c("labelled_id").isNotNull().alias("target"))
    counted = marked.mapInArrow(_counts, "bucket int, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return Models(stored(sums, "importance-counts").toArrow(), targets)


def fit_toxic(docs: DataFrame, toxic: np.ndarray, harmless: np.ndarray, id_col: str, text_col: str) -> ToxicModels:
    """The driver gets a row of counts per bucket that a toxic document has, as no other can tell."""
    rows = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"))
    marked = rows.join(_sides(docs.sparkSession, [harmless, toxic]), c("id") == c("labelled_id")).select(
        "text", (c("side") == 1).alias("toxic"))
    counted = marked.mapInArrow(_toxic_counts, "bucket int, harmless long, toxic long")
    sums = counted.groupBy("bucket").agg(F.sum("harmless").alias("harmless"), F.sum("toxic").alias("toxic"))
    return ToxicModels(stored(sums.where("toxic > 0 OR bucket < 0"), "importance-toxic-counts").toArrow(), toxic, harmless)


def weights(key: Column, text: Column, models: Models, toxic: ToxicModels | None = None) -> Column:
    """Mean log ratio of a text and its score as a toxic one (0 without ``toxic``)."""
    @F.arrow_udf("log_ratio double, toxicity double")
    def weigh(ids: pa.Array, texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])
        ratios, scores = [np.zeros(0)], [np.zeros(0)]
        for b in slices(iter([whole]), "text", SLICE_BYTES):
            doc, bucket = features(b.column("text"), TOXIC_BUCKETS)
            ratios.append(models.log_weights(b.column("id"), doc, bucket % BUCKETS))
            scores.append(toxic.scores(b.column("id"), doc, bucket) if toxic else np.zeros(b.num_rows))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (ratios, scores)], ["log_ratio", "toxicity"])

    return weigh(key.cast("long"), text.cast("string"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the key."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def code(key: Column) -> Column:
    """Keys as integers in millionths: their order, with a fixed step."""
    return F.floor(key * 1e6).cast("long")


def kth_code(codes: DataFrame, k: int) -> int | None:
    """The k-th largest value of column ``code`` by histograms that narrow down to it; None when k is 0."""
    low, high, n = codes.agg(F.min("code"), F.max("code"), F.count(F.lit(1))).first()
    if not n or k <= 0:
        return None
    rank = min(k, n)
    while True:
        width = -(-(high - low + 1) // BINS)
        inside = codes.where((c("code") >= low) & (c("code") <= high))
        found = inside.groupBy(F.floor((c("code") - low) / width).cast("long").alias("bin")).agg(
            F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if rank <= row["n"]:
                break
            rank -= row["n"]
        low = low + row["bin"] * width
        if width == 1:
            return low
        high = min(high, low + width - 1)


class Sampler:
    """The fitted weights and the cut of one corpus; ``reject_toxic`` gives toxic texts weight zero."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int | None = None, reject_toxic: bool = False):
        self.id_col, self.text_col = id_col, text_col
        sides = (["toxic", "harmless"] if reject_toxic else []) + (["rejects"] if k is None else [])
        samples = fitting_samples(labels, ["targets", *sides])
        self.models, self.toxic_models, self.toxic_cut = fit(docs, samples["targets"], id_col, text_col), None, float("inf")
        if reject_toxic:
            self.toxic_models = fit_toxic(docs, samples["toxic"], samples["harmless"], id_col, text_col)
        self.scored = stored(docs.select(c(id_col).alias("id"), self._weights().alias("w")).select("id", "w.*"),
                             "importance-weights")
        scores = self._scores(samples) if sides else {}
        if reject_toxic:
            self.toxic_cut = threshold(*(scores[x]["toxicity"] for x in ("toxic", "harmless")))
        drawable = self.scored.where(~self._toxic(c("toxicity")))
        if k is None:
            k = drawable.where(c("log_ratio") >= threshold(*(scores[x]["log_ratio"] for x in ("targets", "rejects")))).count()
        self.k = k
        self.cut = kth_code(drawable.select(code(self._key(c("log_ratio"), c("id"))).alias("code")), k)
        give_back()

    def _weights(self) -> Column:
        return weights(c(self.id_col), c(self.text_col), self.models, self.toxic_models)

    def _scores(self, samples: dict[str, np.ndarray]) -> dict[str, dict[str, np.ndarray]]:
        """Both scores of the documents of each sample, at most ``FIT_ROWS``; of repeated rows the least. One query for all samples."""
        names = ("log_ratio", "toxicity")
        rows = self.scored.join(_sides(self.scored.sparkSession, list(samples.values())), c("id") == c("labelled_id"))
        found = rows.groupBy("id", "side").agg(*[F.min(x).alias(x) for x in names]).select("side", *names).toArrow()
        side = np.asarray(found.column("side"))
        return {sample: {x: np.asarray(found.column(x))[side == i] for x in names} for i, sample in enumerate(samples)}

    def _toxic(self, score: Column) -> Column:
        """Texts without a telling n-gram are never toxic."""
        return (score > 0) & (score >= self.toxic_cut)

    @staticmethod
    def _key(ratio: Column, key: Column) -> Column:
        return ratio / TEMPERATURE + gumbel(key)

    def _kept(self, key: Column, score: Column) -> Column:
        return (code(key) >= self.cut) & ~self._toxic(score) if self.cut is not None else F.lit(False)

    def decided(self) -> DataFrame:
        """``id, log_ratio, toxicity, key, kept`` of every document."""
        keyed = self.scored.withColumn("key", self._key(c("log_ratio"), c("id")))
        return keyed.withColumn("kept", self._kept(c("key"), c("toxicity")))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The drawn rows of ``docs`` with all their columns; no join, the key is computed again in place."""
        if self.cut is None:
            return docs.limit(0)
        # The caller runs the result: whole texts go to Python, so in small batches.
        small_batches(docs.sparkSession)
        w = self._weights()
        return docs.where(self._kept(self._key(w["log_ratio"], c(self.id_col)), w["toxicity"]))
