"""Indexing as files arrive, and the periodic full refresh."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorespan.fixed_values import ALLOWED_TYPES
from lorespan.plans.indexing import ChunkStore, index_corpus, index_documents
from lorespan.sources.corpus import scan_corpus, type_glob

FILES_PER_BATCH = 10_000
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def start_indexing_stream(spark: SparkSession, path: str, store: ChunkStore, checkpoint: str,
                          root: str | None = None, types=ALLOWED_TYPES, once: bool = True,
                          every: str = "1 minute", loaders=None, **options) -> StreamingQuery:
    """Index new files of a folder in micro-batches.

    Files that arrive during a batch wait for the next one.  A batch that is
    repeated after a failure finds its documents unchanged, or writes the same
    version again, so no chunk appears twice.  Removals and edits in place are
    the refresh's work: a stream of arrivals cannot show them.
    """
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("pathGlobFilter", type_glob(types)).option("maxFilesPerTrigger", FILES_PER_BATCH)
             .load(path).select("path"))

    def run(batch: DataFrame, epoch: int) -> None:
        # A batch has a bounded number of paths; contents are read by the executors.
        paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r["path"]) for r in batch.collect()]
        if paths:
            docs = scan_corpus(spark, paths, root or path, types, loaders)
            index_documents(docs, store, whole_listing=False, **options)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def refresh(spark: SparkSession, path: str, store: ChunkStore, **options):
    """One full reconciliation, to be run by an outside timer."""
    return index_corpus(spark, path, store, **options)
