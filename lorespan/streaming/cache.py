"""Answer-cache maintenance in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespan.fixed_values import CACHE_ENTRIES
from lorespan.functions.embedding import DIM, embed
from lorespan.operators.cache import cache_append
from lorespan.sources.snapshots import Snapshots


def start_cache_stream(answers: DataFrame, store: Snapshots, checkpoint: str,
                       cap: int = CACHE_ENTRIES, dim: int = DIM,
                       model: Callable[[Column], Column] | None = None, once: bool = True,
                       every: str = "10 seconds", keep: int = 5) -> StreamingQuery:
    """``answers(arrival, question, answer, created_at)`` into the cache table.

    A batch builds version ``epoch + 1`` from the version before it, so a
    repeated batch adds nothing twice.  Only the newest ``cap`` rows are embedded.
    The newest ``keep`` versions stay, so the store does not grow with the batches; a
    repeated batch needs two, readers the others.
    """
    if keep < 2:
        raise ValueError("a repeated batch needs the version before it")

    def run(batch: DataFrame, epoch: int) -> None:
        newest = batch.where(F.length("answer") > 0).orderBy(F.desc("arrival")).limit(cap)
        new = newest.withColumn("vec", embed(F.col("question"), dim, model))
        store.publish(cache_append(store.read(before=epoch + 1), new, cap), epoch + 1)
        store.prune(keep)

    writer = answers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()
