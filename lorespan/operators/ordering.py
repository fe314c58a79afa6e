"""Consecutive numbers over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespan.session import cut_lineage

SPAN = 65_536


# The low bits of ``monotonically_increasing_id`` are the place of a row in its partition.
_PLACE_BITS = 33


def number_rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add ``name`` = 1, 2, 3 … in the given order (of any types, unique in ``df``).

    Rows are dealt to ranges of the order and sorted in them, and written once with
    their places.  The counts of the ranges, one row for each partition, are summed
    up; the rows themselves never meet in one task, however sparse the order is.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_row_at", F.monotonically_increasing_id()))
    part = F.shiftright("_row_at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("_row_part")).agg(F.count(F.lit(1)).alias("_row_n"))
    before = W.orderBy("_row_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_row_part", F.coalesce(F.sum("_row_n").over(before), F.lit(0)).alias("_row_start"))
    # A row for each partition of the written table.
    return (placed.withColumn("_row_part", part).join(F.broadcast(starts), "_row_part")
            .withColumn(name, F.col("_row_start") + F.col("_row_at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1)
            .drop("_row_part", "_row_start", "_row_at"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1,
               rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key.  Spark limits each key before the shuffle."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def running_total(df: DataFrame, keys: list[str], position: str, value: str, name: str,
                  span: int = SPAN) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier positions of the key.

    A key of any size is summed in spans of its whole-number position, so a key
    that holds most of the rows is still shared out.
    """
    keyed = df.withColumn("_span", F.floor(F.col(position) / F.lit(span)))
    totals = keyed.groupBy(*keys, "_span").agg(F.sum(value).alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "_span", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_row_start"))
    inside = (W.partitionBy(*keys, "_span").orderBy(position)
              .rowsBetween(W.unboundedPreceding, -1))
    return (keyed.join(starts, [*keys, "_span"])
            .withColumn(name, F.col("_row_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_span", "_row_start"))
