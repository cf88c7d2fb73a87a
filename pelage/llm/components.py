"""Connected components of an edge table by joins, with written rounds.

Labels only fall. A round lets every node take the least label next to it and
then that label's own label (pointer jumping), so chains halve. Each round is
written to the shared folder and read back: lost executors repeat one round.
Edges that are stars already take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.storage import stored

c = F.col


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and is no lower end."""
    ends = edges.select(c("hi").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(
        edges.select(c("lo").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    other = ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return other.where("above > 1 OR above + below > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` (least id of the component) for every id that an edge ``a, b`` names.

    Large-star and small-star in turn: in a large star every neighbour above a
    node is tied to the least node next to it; in a small star every neighbour
    below. The edges become stars around the least ids. Least neighbours are
    sums per key before the shuffle, and a hub is only the small side of its
    joins, so no task needs all edges of a node together.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        f"{name}-edges")
    while not _are_stars(edges):
        both = edges.select(c("hi").alias("u"), c("lo").alias("v")).union(
            edges.select(c("lo").alias("u"), c("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(c("v").alias("hi"), c("m").alias("lo"))
                 .where("hi <> lo").distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(down, "hi")
                 .select(F.explode(F.array(F.struct(c("hi").alias("hi"), c("m").alias("lo")),
                                           F.struct(c("lo").alias("hi"), c("m").alias("lo")))).alias("e"))
                 .select("e.*").where("hi <> lo").distinct())
        edges = stored(small, f"{name}-round")
    return edges.select(c("hi").alias("id"), c("lo").alias("component")).union(
        edges.select(c("lo").alias("id"), c("lo").alias("component")).distinct())
