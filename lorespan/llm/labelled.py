"""A bounded sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, skip: int = 0) -> DataFrame:
    """``doc_id, text, target`` of at most ``rows`` labelled ids, in the order of a hash of the id.

    ``skip`` leaves out ids whose hash falls into the first tenth, for held-out tests.
    An id that is labelled twice counts once, with the greater label; ids and labels
    that are null are left out.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
              .groupBy("doc_id").agg(F.max(target).cast("long").alias("target")))
    if skip:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) >= skip)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the documented size of the sample
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
