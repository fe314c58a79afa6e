"""One indexing run: documents in, chunk log and manifest out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions.embedding import DIM, embed
from lorespan.operators.chunking import chunk, flat_metadata
from lorespan.operators.indexing import (
    CHANGED, KEPT, NEW, REMOVED, diff_manifest, live_chunks, manifest_from, run_report,
    superseded, to_index,
)
from lorespan.session import cut_lineage
from lorespan.sources.corpus import MAX_CONTENT_BYTES, TOO_LARGE, scan_corpus
from lorespan.sources.snapshots import Snapshots
from lorespan.sources.stores import CHUNKS, DEAD, MANIFEST


class ChunkStore:
    """The manifest, the append-only chunk log and the superseded records of a corpus.

    A run writes the same version number in all three, the manifest last.  Readers
    go no further than the manifest's version, so they see a run whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        root = root.rstrip("/")
        self.manifest = Snapshots(spark, f"{root}/manifest", MANIFEST)
        self.chunks = Snapshots(spark, f"{root}/chunks", CHUNKS)
        self.dead = Snapshots(spark, f"{root}/dead", DEAD)

    def current_chunks(self) -> DataFrame:
        version = self.manifest.latest() or 0
        return live_chunks(self.chunks.read_all(version), self.dead.read_all(version))

    def compact(self, root: str) -> ChunkStore:
        """Copy of the store below another folder without the superseded chunks."""
        fresh, version = ChunkStore(self.spark, root), self.manifest.latest()
        if version is not None:
            fresh.chunks.publish(self.current_chunks(), version)
            fresh.manifest.publish(self.manifest.read(), version)
        return fresh


def chunk_rows(docs: DataFrame, indexed_in: int, dim: int = DIM,
               model: Callable[[Column], Column] | None = None, **split_options) -> DataFrame:
    """Chunk table rows with flat metadata and a vector each."""
    rows = flat_metadata(chunk(docs, **split_options))
    if "loader_meta" not in rows.columns:
        rows = rows.withColumn("loader_meta", F.lit(None).cast("map<string,string>"))
    return (rows.withColumn("vec", embed(F.col("text"), dim, model))
            .withColumn("indexed_in", F.lit(indexed_in).cast("long")))


def index_documents(docs: DataFrame, store: ChunkStore, *, whole_listing: bool = True,
                    now: datetime | None = None, dim: int = DIM,
                    model: Callable[[Column], Column] | None = None,
                    **split_options) -> tuple[DataFrame, DataFrame]:
    """Index what is new or changed; returns ``(report, skipped)``.

    The first pass over the documents keeps identity and hash only, the second
    one cuts the touched documents.  The run appends its own chunks; nothing
    written earlier is read back or rewritten.  Repeating a run that failed half
    way overwrites the same version.
    """
    now = now or datetime.now(timezone.utc)
    records = cut_lineage(docs.withColumn("readable", F.col("text").isNotNull()).drop("text"))
    manifest = store.manifest.read()
    version = (store.manifest.latest() or 0) + 1
    diff = diff_manifest(records, manifest)
    if not whole_listing:
        diff = diff.withColumn(
            "status", F.when(F.col("status") == REMOVED, KEPT).otherwise(F.col("status")))
    # A known file that has grown too large to read keeps its record and chunks.
    unread = records.where(F.col("reason") == TOO_LARGE).select("doc_id", F.lit(True).alias("unread")) \
        if "reason" in records.columns else None
    if unread is not None:
        diff = diff.join(unread, "doc_id", "left").withColumn("status", F.when(
            F.col("unread") & (F.col("status") == CHANGED), KEPT).otherwise(F.col("status"))).drop("unread")
    diff = cut_lineage(diff)

    work = docs if store.manifest.latest() is None else to_index(docs, diff)
    store.chunks.publish(
        chunk_rows(work.drop("reason"), version, dim, model, **split_options), version)
    store.dead.publish(superseded(diff, manifest), version)
    made = store.spark.read.schema(store.chunks.schema).parquet(store.chunks.path(version))
    store.manifest.publish(
        manifest_from(records, made, diff, manifest, F.lit(now), version), version)

    pending = diff.where(F.col("status").isin(NEW, CHANGED)).select("doc_id")
    skipped = (records.join(pending, "doc_id", "left_semi")
               .join(made.select("doc_id"), "doc_id", "left_anti")
               .select("doc_id", F.coalesce("reason", F.lit("no chunks")).alias("reason")))
    if unread is not None:
        kept = diff.where(F.col("status") == KEPT).select("doc_id")
        skipped = skipped.unionByName(records.where(F.col("reason") == TOO_LARGE).join(kept, "doc_id", "left_semi")
                                      .select("doc_id", "reason"))
    return run_report(diff, made), skipped


def index_corpus(spark: SparkSession, path: str, store: ChunkStore, root: str | None = None,
                 loaders=None, limit: int = MAX_CONTENT_BYTES, **options) -> tuple[DataFrame, DataFrame]:
    """Bring the store in line with a folder."""
    docs = scan_corpus(spark, path, root, loaders=loaders, limit=limit)
    return index_documents(docs, store, **options)
