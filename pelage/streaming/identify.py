"""Ranking a stream of probes against a gallery that is already built."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelage.operators.retrieval import best_of_tiles, nearest_in_tile
from pelage.operators.tiles import block_count, block_of, placed_join
from pelage.session import scratch_dir

c = F.col


@dataclass(frozen=True)
class PlacedGallery:
    """A gallery written once, dealt out to the buckets of a table by block."""

    spark: SparkSession
    table: str
    blocks: int
    rows: int

    def items(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def place_gallery(gallery: DataFrame) -> PlacedGallery:
    """Writes ``id, embedding`` as a bucketed table in the shared folder; its rows are counted here, once."""
    spark = gallery.sparkSession
    items = gallery.filter(c("embedding").isNotNull()).select("id", "embedding")
    rows = items.count()
    blocks = block_count(rows)
    table = f"pelage_gallery_{uuid.uuid4().hex}"
    items.withColumn("block", block_of(c("id"), blocks)).repartition(blocks, "block").write.bucketBy(
        blocks, "block").option("path", scratch_dir(spark, "placed-gallery")).format("parquet").saveAsTable(table)
    return PlacedGallery(spark, table, blocks, rows)


def rank_batch(probes: DataFrame, gallery: PlacedGallery, k: int) -> DataFrame:
    """``probe_id, rank, gallery_id, similarity`` of a batch of probes.

    Every probe goes to each block of the gallery; the gallery itself stays in
    its buckets. A task holds the batch and one block.
    """
    asked = probes.filter(c("embedding").isNotNull()).select("id", "embedding")
    visits = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(gallery.blocks - 1))))
    fn, schema = nearest_in_tile(probes, gallery.items(), k)
    return best_of_tiles(placed_join(visits, gallery.items(), "block", fn, schema), k)


def identify_stream(
    probes: DataFrame, gallery: DataFrame | PlacedGallery, output: str, checkpoint: str, k: int = 5,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Top-k gallery matches of each arriving probe, written as Parquet.

    Stateless. Each micro-batch writes its own folder, so a batch that is run
    again after a failure replaces its output instead of doubling it. The
    gallery is placed once, before the first batch. ``trigger`` takes the
    arguments of ``DataStreamWriter.trigger`` (all that is there, then stop, by
    default); the source's limit of files per batch bounds what a task holds.
    """
    placed = gallery if isinstance(gallery, PlacedGallery) else place_gallery(gallery)

    def rank(batch: DataFrame, batch_id: int) -> None:
        rank_batch(batch, placed, k).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        probes.writeStream.foreachBatch(rank)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
