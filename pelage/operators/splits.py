"""Splits, samples, ids and evaluation sets.

Every random choice is an order by a seeded md5 key: reproducible, independent
of the partitioning, and the same in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelage.functions.ordering import random_key
from pelage.operators.prefix import positions, row_numbers, running, unused
from pelage.session import materialize

c = F.col


def dense_label_ids(images: DataFrame, identity: str = "identity") -> DataFrame:
    """``identity, label``: 0-based position of each identity in sorted order."""
    return positions(images.select(identity).filter(c(identity).isNotNull()).distinct(), [identity], "label")


def filter_min_per_identity(images: DataFrame, minimum: int = 5, identity: str = "identity") -> DataFrame:
    """Images of the identities that have at least ``minimum`` of them."""
    enough = images.groupBy(identity).count().filter(c("count") >= minimum).select(identity)
    return images.join(enough, identity, "left_semi")


def identity_split(
    images: DataFrame, minimum: int = 5, val_share: float = 0.15, test_share: float = 0.15,
    seed: int = 42, identity: str = "identity",
) -> DataFrame:
    """``identity, n_images, split``: whole identities go to test, then val, then train.

    Identities are taken in hash order; test is filled until it has
    int(share x images), then val, the rest is train.
    """
    # Much smaller than the images and read several times below: counted once.
    sizes = materialize(
        images.groupBy(identity).agg(F.count("*").alias("n_images")).filter(c("n_images") >= minimum),
        "identity-sizes")
    before = running(
        sizes, [], [random_key(seed, identity), c(identity)], {"_before": ("sum", c("n_images"))}, inclusive=False)
    total = sizes.agg(F.sum("n_images")).scalar()
    test, val = F.floor(total * F.lit(test_share)), F.floor(total * F.lit(val_share))
    test_filled = before.filter(c("_before") < test).agg(F.coalesce(F.sum("n_images"), F.lit(0))).scalar()
    split = (
        F.when(c("_before") < test, "test")
        .when(c("_before") - test_filled < val, "val")
        .otherwise("train")
    )
    return before.select(identity, "n_images", split.alias("split"))


def image_split(
    images: DataFrame, share: float = 0.9, seed: int = 42, key: str = "image_id", source: str = "source",
) -> DataFrame:
    """Adds ``split``: per source, the first int(share x n) images in hash order are train."""
    number, train = unused(images, "_rn", "_train")
    sizes = images.groupBy(source).agg(F.floor(F.count("*") * F.lit(share)).alias(train))
    numbered = row_numbers(images, [source], random_key(seed, key), [key], number)
    split = F.when(c(number) <= c(train), "train").otherwise("val")
    return numbered.join(sizes, source).withColumn("split", split).drop(number, train)


def sequential_ids(annotations: DataFrame, key: str, split: str = "split", name: str = "annotation_id") -> DataFrame:
    """Contiguous 0-based ids, all of train before val; hash order of ``key`` within."""
    return positions(annotations, [F.when(c(split) == "train", 0).otherwise(1), random_key(0, key), key], name)


# Rows that one task may sort to settle the last places of a sample, and windows up to which Spark limits early.
EDGE_ROWS = 65_536
GROUP_LIMIT = 1_000


def _first_n(df: DataFrame, n: int, order: Column, ties: str) -> DataFrame:
    """The n rows of least ``order`` (a hexadecimal text of a hash), then ``ties``.

    Counts per leading digits find the cut: everything below it passes in
    parallel, and only the few rows that share the cut's digits are sorted.
    The driver sees at most 4,096 counts per pass.
    """
    keyed = df.withColumn("_key", order)
    cut, rest = "", n
    while True:
        digits = len(cut) + 3
        found = keyed.filter(c("_key").startswith(cut)).groupBy(F.substring("_key", 1, digits).alias("p")).agg(
            F.count("*").alias("n")).collect()
        if sum(row["n"] for row in found) <= rest:
            return keyed.filter(c("_key").startswith(cut) | (c("_key") < cut)).drop("_key")
        for row in sorted(found):
            if rest <= row["n"]:
                break
            rest -= row["n"]
        cut = row["p"]
        if row["n"] <= EDGE_ROWS or digits >= 32:
            break
    edge = keyed.filter(c("_key").startswith(cut)).orderBy("_key", ties).limit(rest)
    return keyed.filter(c("_key") < cut).union(edge).drop("_key")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(n, rows) rows in hash order, found without a sort of n rows."""
    return _first_n(df, n, random_key(seed, key), key)


def _first_per(df: DataFrame, identity: str, order: list[Column], n: int) -> DataFrame:
    (number,) = unused(df, "_rn")
    w = Window.partitionBy(identity).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(c(number) <= n).drop(number)


def limit_per_identity(df: DataFrame, n: int, position: str, identity: str = "identity") -> DataFrame:
    """The first n rows of each identity in input order; for large n a large identity is numbered in parts."""
    if n > GROUP_LIMIT:
        (number,) = unused(df, "_rn")
        return row_numbers(df, [identity], c(position), [], number).filter(c(number) <= n).drop(number)
    return _first_per(df, identity, [c(position)], n)


def sample_per_identity(df: DataFrame, n: int, key: str, seed: int = 42, identity: str = "identity") -> DataFrame:
    """n rows of each identity in hash order; for large n a large identity is numbered in parts."""
    if n > GROUP_LIMIT:
        (number,) = unused(df, "_rn")
        return row_numbers(df, [identity], random_key(seed, key), [key], number).filter(c(number) <= n).drop(number)
    return _first_per(df, identity, [random_key(seed, key), c(key)], n)


def conflict_anti(base: DataFrame, priority: DataFrame, identity: str = "identity") -> DataFrame:
    """Base rows whose identity is not among the priority identities."""
    return base.join(priority.select(identity).distinct(), identity, "left_anti")


def augmented_eval_set(
    base: DataFrame, priority: DataFrame, num_images: int | None = None, max_per_identity: int | None = None,
    key: str = "image_id", seed: int = 42, identity: str = "identity",
) -> DataFrame:
    """Priority identities first, then non-conflicting base images, cut at ``num_images``.

    Priority images are sampled to the cap per identity, base images are
    capped in input order (``key``). A set that the priority images overfill is
    a sample of them.
    """
    first = priority if max_per_identity is None else sample_per_identity(
        priority, max_per_identity, key, seed, identity)
    rest = conflict_anti(base, priority, identity)
    if max_per_identity is not None:
        rest = limit_per_identity(rest, max_per_identity, key, identity)
    both = first.withColumn("is_priority", F.lit(True)).unionByName(rest.withColumn("is_priority", F.lit(False)))
    if num_images is None:
        return both
    turn = F.concat(F.when(c("is_priority"), "0").otherwise("1"), random_key(seed, key))
    return _first_n(both, num_images, turn, key)


def eval_set(
    base: DataFrame, num_images: int | None = None, max_per_identity: int | None = None,
    key: str = "image_id", seed: int = 42, identity: str = "identity",
) -> DataFrame:
    """Base images only: capped per identity, then sampled."""
    capped = base if max_per_identity is None else limit_per_identity(base, max_per_identity, key, identity)
    return capped if num_images is None else sample_n(capped, num_images, key, seed)


def split_leakage(images: DataFrame, identity: str = "identity", split: str = "split") -> DataFrame:
    """Identities that occur in more than one split (none in a sound split)."""
    return (
        images.groupBy(identity).agg(F.countDistinct(split).alias("n_splits"))
        .filter(c("n_splits") > 1)
    )
