"""Benchmark items inside documents by MinHash containment (DataFrame functions only).

An item counts as found when the document holds at least ``threshold`` of its
distinct five-word shingles (lower case, white space aside). Items are
partitioned by size. In each partition an item is represented by its smallest
shingle hashes, just so many that not all of them can be missing from a
document that holds enough of the item; a document is represented, in each
partition anew, by its shingle hashes up to the largest that a signature of
that partition uses. A hash that both have in one partition makes a candidate,
so the search loses nothing, and the exact shingles decide.

Cases: a NULL text is empty; an empty text and a text or item of fewer than
five words have no shingles and match nothing; repeated rows give one result
per pair of ids, with the most shared shingles; NULL ids are values of their
own; empty tables give an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelage.llm.storage import stored

c = F.col

WORDS = 5
# A side of at most so many rows (each a hash or a shingle) is sent to all executors.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, k: int = WORDS) -> Column:
    """Distinct shingles of a text, as texts."""
    return let(words(text), lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(
        F.array().cast("array<string>")))


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hash of every run of k words of a text."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= k, F.transform(
        F.sequence(F.lit(0), F.size(h) - k),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")))


def signatures(items: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``item, size, band, hash``: the smallest hashes of each item.

    Of n shingles at most n - ceil(threshold * n) may be missing, so one more
    than that are taken. ``band`` is the size partition (powers of two).
    """
    hashed = items.select(
        c(id_col).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(c(text_col)))).alias("h"))
    sized = hashed.withColumn("size", F.size("h")).where("size > 0")
    taken = c("size") - F.ceil(c("size") * F.lit(str(threshold)).cast("decimal(9,6)")) + 1
    return sized.select("item", "size", F.floor(F.log2("size")).cast("int").alias("band"),
                        F.explode(F.slice("h", F.lit(1), taken.cast("int"))).alias("hash"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay within the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def candidates(docs: DataFrame, id_col: str, text_col: str, signed: DataFrame) -> DataFrame:
    """``doc`` of each document that shares a signature hash with some item, once per id.

    ``signed`` must be a written table. Each size partition is searched by
    itself: a document shows it the hashes up to the largest of its own
    signatures, and meets only those. The driver gets one row per partition,
    as many as sizes have powers of two.
    """
    bands = signed.groupBy("band").agg(F.max("hash").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    if not bands:
        return docs.select(c(id_col).alias("doc")).limit(0)
    sketch = docs.select(c(id_col).alias("doc"), F.array_distinct(shingle_hashes(c(text_col))).alias("h"))
    partitions = F.array(*[F.struct(F.lit(row["band"]).alias("band"), F.lit(row["top"]).cast("bigint").alias("top"))
                           for row in sorted(bands)])
    shown = sketch.select("doc", "h", F.explode(partitions).alias("p")).select(
        "doc", c("p.band").alias("band"), F.explode(F.filter("h", lambda h: h <= c("p.top"))).alias("hash"))
    keys = signed.select("band", "hash").distinct()
    return shown.join(sized(keys, sum(row["n"] for row in bands)), ["band", "hash"], "left_semi").select("doc").distinct()


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc, item, n_shingles, n_shared`` for every document and item it holds enough of."""
    return contained_versions(docs, items, id_col, text_col, item_id, item_text, threshold).groupBy("doc", "item").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))


def contained_versions(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """As ``contained``, for each text of an id by itself; ``version`` is its ``xxhash64``."""
    signed = stored(signatures(items, item_id, item_text, threshold), "item-signatures")
    found = candidates(docs, id_col, text_col, signed).withColumnRenamed("doc", "found")
    texts = docs.select(c(id_col).alias("doc"), c(text_col).alias("text"))
    held = texts.join(found, c("doc").eqNullSafe(c("found")), "left_semi")
    shown = held.select("doc", F.xxhash64("text").alias("version"), F.explode(shingles(c("text"))).alias("shingle"))
    parts = stored(items.select(c(item_id).alias("item"), shingles(c(item_text)).alias("s")).select(
        "item", F.size("s").alias("n_shingles"), F.explode("s").alias("shingle")).distinct(), "item-shingles")
    # The same text may come twice under one id: its shingles count once.
    pairs = shown.join(sized(parts, parts.count()), "shingle").select(
        "doc", "version", "item", "n_shingles", "shingle").distinct()
    counted = pairs.groupBy("doc", "version", "item", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = c("n_shared") >= c("n_shingles") * F.lit(str(threshold)).cast("decimal(9,6)")
    return counted.where(enough)
