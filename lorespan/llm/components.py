"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """The least of each vertex and its neighbours; sums up in each task before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every vertex of ``a, b`` edges, the root being the least of its component.

    Each round every vertex hands its larger, then its smaller neighbours the least
    vertex it knows; edges only get fewer and end as stars.  A round is written to the
    shared folder, so the plan stays short.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            small.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(star)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
