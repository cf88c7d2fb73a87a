"""Margin heads and triplet loss evaluated over an embedding table.

``items``: ``id, label, embedding``; ``prototypes``: ``id`` (the class),
``center``, ``embedding``. All centers of a class fall into one gallery block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelage.functions.vectors import l2_norm
from pelage.operators.retrieval import Best, _best_columns, missing_last
from pelage.operators.tiles import Block, TileReduce, block_count, label_codes, same_cells, scaled_similarities, tile_join

c = F.col

# Fixed value: added to each coordinate difference of a triplet distance.
DISTANCE_EPS = 1e-6


@dataclass(frozen=True)
class Head:
    """Scale and margins of a classification head; ``centers`` per class."""

    scale: float = 30.0
    angular_margin: float = 0.0
    cosine_margin: float = 0.0
    centers: int = 1

    def logits(self, cosine: np.ndarray, is_target: np.ndarray) -> np.ndarray:
        adjusted = cosine - self.cosine_margin
        if self.angular_margin:
            m = self.angular_margin
            sine = np.sqrt(np.maximum(0.0, 1.0 - cosine * cosine))
            widened = cosine * math.cos(m) - sine * math.sin(m)
            # Past pi - m the angle would wrap: a linear penalty instead.
            adjusted = np.where(
                cosine > math.cos(math.pi - m), widened, cosine - math.sin(math.pi - m) * m)
        return np.where(is_target, adjusted, cosine) * self.scale


PLAIN = Head(scale=1.0)
ARCFACE = Head(angular_margin=0.5)
SUBCENTER_ARCFACE = Head(angular_margin=0.5, centers=3)
COSFACE = Head(cosine_margin=0.35)


# Labels whose sums a task holds before it hands them on.
HELD_LABELS = 4096


def _codes(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number per row for its keys, and the first row of each number."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        found = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * max(len(found.dictionary), 1) + np.asarray(found.indices)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _vector_sums(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Componentwise sums per keys, batch by batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_LABELS):
            part = batch.slice(at, HELD_LABELS)
            code, first = _codes(part, keys)
            lengths = np.asarray(pc.list_value_length(part.column("embedding")))
            if lengths.min() != lengths.max():
                raise ValueError("vectors must be of one length")
            values = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(first)))
            sums = np.add.reduceat(values[order].astype(np.float64), starts)
            columns = {k: part.column(k).take(pa.array(first)) for k in keys}
            yield pa.RecordBatch.from_pydict({
                **columns, "total": pa.array(list(sums), pa.list_(pa.float64())),
                "n": pa.array(np.bincount(code, minlength=len(first)).astype(np.int64))})


def _added_sums(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Means of rows that are sorted by their keys; one vector is held."""
    held: tuple | None = None
    done: list[tuple] = []

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k, _, _ in done], kinds[i]) for i in range(len(keys))],
             pa.array([total / n for _, total, n in done], pa.list_(pa.float64()))], names=[*keys, "embedding"])

    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds = [batch.schema.field(k).type for k in keys]
        for row, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys])):
            total, n = batch.column("total")[row].values.to_numpy(), batch.column("n")[row].as_py()
            if held is not None and held[0] == key:
                held = (key, held[1] + total, held[2] + n)
                continue
            if held is not None:
                done.append(held)
            held = (key, total, n)
            if len(done) >= HELD_LABELS:
                yield finished()
                done = []
    if held is not None:
        done.append(held)
        yield finished()


def class_means(items: DataFrame, center: Column | None = None) -> DataFrame:
    """``id, center, embedding``: a prototype per label (and ``center``), the mean vector; its length does not matter.

    Vectors are added up in their Arrow batches, so a label with very many
    items sends a sum per batch and no vector is cut into rows.
    """
    keyed = items.filter(c("label").isNotNull() & c("embedding").isNotNull()).select(
        c("label").alias("id"), (F.lit(0) if center is None else center).cast("int").alias("center"),
        c("embedding").cast("array<double>").alias("embedding"))
    keys = ["id", "center"]
    fields = [keyed.schema[k] for k in keys]
    sums = keyed.mapInArrow(lambda b: _vector_sums(b, keys), T.StructType([
        *fields, T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]))
    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        lambda b: _added_sums(b, keys), T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def _blocks(items: DataFrame, prototypes: DataFrame) -> tuple[int, int]:
    return block_count(items.count()), block_count(prototypes.count())


def _class_cosines(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a gallery block, and the best cosine over the centers of each."""
    cosine = left.unit @ right.unit.T
    order = np.argsort(right.ids, kind="stable")
    classes, first = np.unique(right.ids[order], return_index=True)
    return classes, np.maximum.reduceat(cosine[:, order], first, axis=1)


def head_logits(items: DataFrame, prototypes: DataFrame, head: Head) -> DataFrame:
    """``id, class, is_target, logit`` of every item and class."""
    items = items.select("id", "label", "embedding")
    id_type = items.schema["id"].dataType.simpleString()
    class_type = prototypes.schema["id"].dataType.simpleString()

    def logits(left: Block, right: Block, _diagonal: bool) -> dict:
        classes, cosine = _class_cosines(left, right)
        target = left.labels[:, None] == classes[None, :]
        values = head.logits(cosine, target)
        n = len(classes)
        return {
            "id": np.repeat(left.ids, n), "class": np.tile(classes, len(left.ids)),
            "is_target": target.ravel(), "logit": values.ravel(),
        }

    schema = f"id {id_type}, class {class_type}, is_target boolean, logit double"
    return tile_join(items, prototypes, logits, schema, blocks=_blocks(items, prototypes))


def prototype_logits(items: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Cosine of every item with every class, best sub-center."""
    return head_logits(items, prototypes, PLAIN)


def _merged(items: DataFrame, prototypes: DataFrame, head: Head, k: int) -> DataFrame:
    """Per item what its logits come to: ``id, lse, mean, target, best`` (the ``k`` highest classes).

    A tile sends one row per item: the greatest logit, the sum of exponentials
    below it, total, target, and its ``k`` best classes. Such rows add up, so
    the item x class matrix is never a table and no exponential overflows.
    """
    items = items.select("id", "label", "embedding")
    id_type, class_type = (df.schema["id"].dataType.simpleString() for df in (items, prototypes))

    def partial(left: Block, right: Block, _diagonal: bool) -> dict:
        classes, cosine = _class_cosines(left, right)
        target = left.labels[:, None] == classes[None, :]
        logit = head.logits(cosine, target)
        most = logit.max(axis=1)
        best: list[list[dict]] = [[] for _ in left.ids]
        if k:
            for i, j, _ in zip(*_best_columns(logit, classes, k)):
                best[i].append({"logit": float(logit[i, j]), "class": classes[j].item() if hasattr(classes[j], "item") else classes[j]})
        return {
            "id": left.ids, "most": most, "exps": np.exp(logit - most[:, None]).sum(axis=1), "total": logit.sum(axis=1),
            "classes": np.full(len(left.ids), len(classes)), "best": best,
            "target": pa.array(np.where(target, logit, 0.0).sum(axis=1), mask=~target.any(axis=1)),
        }

    schema = (f"id {id_type}, most double, exps double, total double, classes long, "
              f"best array<struct<logit: double, class: {class_type}>>, target double")
    tiles = tile_join(items, prototypes, partial, schema, blocks=_blocks(items, prototypes))
    parts = tiles.groupBy("id").agg(
        F.max("most").alias("most"), F.collect_list(F.struct("most", "exps")).alias("parts"),
        (F.sum("total") / F.sum("classes")).alias("mean"), F.max("target").alias("target"),
        F.flatten(F.collect_list("best")).alias("best"))
    exps = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["exps"] * F.exp(p["most"] - c("most")))
    columns = ["id", (c("most") + F.log(exps)).alias("lse"), "mean", "target"]
    if not k:
        return parts.select(*columns)
    ordered = F.slice(F.array_sort(F.transform("best", lambda b: F.struct(
        (-b["logit"]).alias("neg"), b["class"].alias("class")))), 1, k)
    return parts.select(*columns, F.transform(ordered, lambda b: F.struct(
        b["class"].alias("class"), (-b["neg"]).alias("logit"))).alias("best"))


def head_summary(items: DataFrame, prototypes: DataFrame, head: Head, k: int = 5) -> DataFrame:
    """``id, target, lse, loss, best``: what a training step or a report needs of an item's logits.

    ``target`` is the logit of the item's own class (NULL without one), ``loss``
    the cross entropy, ``best`` the ``k`` highest classes with their logits.
    """
    rows = _merged(items, prototypes, head, max(k, 1))
    return rows.select("id", "target", "lse", (c("lse") - c("target")).alias("loss"), "best")


def smoothed_cross_entropy(items: DataFrame, prototypes: DataFrame, head: Head = ARCFACE,
                           smoothing: float = 0.1) -> DataFrame:
    """One row: mean label-smoothed cross entropy of the head, and the number of items."""
    per_item = _merged(items.filter(c("label").isNotNull()), prototypes, head, 0).withColumn(
        "target", F.coalesce("target", F.lit(0.0)))
    loss = (c("lse") - c("target")) * (1 - smoothing) + (c("lse") - c("mean")) * smoothing
    return per_item.agg(F.avg(loss).alias("loss"), F.count("*").alias("n_items"))


class _Partners(TileReduce):
    """The most similar item of the same and of another label, per item of a block."""

    def start(self, left: Block):
        return left, (Best(len(left.ids), 1), Best(len(left.ids), 1))

    def add(self, state, right: Block) -> None:
        left, (same, other) = state
        values = missing_last(scaled_similarities(left, right), left, right)
        values[same_cells(left.ids, right.ids)] = -np.inf
        a, b = label_codes(left, right)
        equal = a[:, None] == b[None, :]
        same.add(np.where(equal, values, -np.inf), right.ids)
        values[equal] = -np.inf
        other.add(values, right.ids)

    def result(self, state) -> dict:
        left, kinds = state
        return {
            "anchor": np.concatenate([left.ids[x.row] for x in kinds]),
            "found": np.concatenate([x.taken[0] if x.taken else left.ids[:0] for x in kinds]),
            "code": np.concatenate([x.code for x in kinds]),
            "is_same": np.concatenate([np.full(len(x.row), wanted) for x, wanted in zip(kinds, (True, False))])}


def triplets(items: DataFrame) -> DataFrame:
    """``anchor, positive, negative``: per item its most similar item of the same
    and of another label; items that lack one of them are left out."""
    items = items.select("id", "label", "embedding").filter(c("label").isNotNull())
    id_type = items.schema["id"].dataType.simpleString()
    blocks = block_count(items.count())
    schema = f"anchor {id_type}, found {id_type}, code long, is_same boolean"
    tiles = tile_join(items, items, _Partners(), schema, blocks=(blocks, blocks))
    rank = F.struct((-c("code")).alias("neg"), "found")
    return tiles.groupBy("anchor").agg(
        F.min(F.when(c("is_same"), rank))["found"].alias("positive"),
        F.min(F.when(~c("is_same"), rank))["found"].alias("negative"),
    ).filter(c("positive").isNotNull() & c("negative").isNotNull())


def triplet_loss(triplet_table: DataFrame, embeddings: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row: mean of max(0, d(a, p) - d(a, n) + margin), and the number of triplets."""
    joined = triplet_table
    for role in ("anchor", "positive", "negative"):
        side = embeddings.select(c("id").alias(role), c("embedding").cast("array<double>").alias(f"v_{role}"))
        joined = joined.join(side, role)

    def distance(role: str):
        return l2_norm(F.zip_with(c("v_anchor"), c(f"v_{role}"), lambda x, y: x - y + F.lit(DISTANCE_EPS)))

    loss = F.greatest(F.lit(0.0), distance("positive") - distance("negative") + F.lit(margin))
    return joined.agg(F.avg(loss).alias("loss"), F.count("*").alias("n_triplets"))
