"""Incremental indexing: what changed, which chunks go, what the manifest says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import ALLOWED_TYPES, MAX_UPLOAD_MB
from lorespan.functions.identity import base_name, extension
from lorespan.operators.chunking import chunk_lists
from lorespan.session import is_small

NEW, CHANGED, UNCHANGED, REMOVED, KEPT = "NEW", "CHANGED", "UNCHANGED", "REMOVED", "KEPT"


def triage(files: DataFrame, types=ALLOWED_TYPES, max_bytes: int = MAX_UPLOAD_MB * 1024 * 1024) -> DataFrame:
    """``files(filename, size_bytes)`` with ``name`` and the first ``reason`` to refuse, if any."""
    name = base_name(F.regexp_replace(F.coalesce("filename", F.lit("")), "/+$", ""))
    ext = extension(F.col("name"))
    reason = (F.when(F.col("name").isin("", "."), F.lit("Invalid filename"))
              .when(~ext.isin(*types), F.concat(F.lit("Unsupported file type: ."), ext))
              .when(F.col("size_bytes") > max_bytes,
                    F.lit(f"File exceeds {max_bytes // (1024 * 1024)} MB limit")))
    return files.withColumn("name", name).withColumn("reason", reason)


def diff_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare ``(doc_id, hash)`` with the manifest.

    Records of other origins (ids without ``file:``) are not removed when the
    listing does not hold them.  Only ids, hashes and the number of chunks of a
    record shuffle, never its chunk ids or content.
    """
    now = current.select("doc_id", F.col("hash").alias("hash"))
    old = manifest.select("doc_id", F.col("hash").alias("old_hash"),
                          F.coalesce(F.size("chunk_ids"), F.lit(0)).cast("long").alias("n_old_chunks"))
    status = (F.when(F.col("old_hash").isNull(), NEW)
              .when(F.col("hash").isNull(),
                    F.when(F.startswith("doc_id", F.lit("file:")), REMOVED).otherwise(KEPT))
              .when(F.col("hash") == F.col("old_hash"), UNCHANGED)
              .otherwise(CHANGED))
    return (now.join(old, "doc_id", "full_outer")
            .select("doc_id", status.alias("status"), "hash", "old_hash", "n_old_chunks"))


def to_index(docs: DataFrame, diff: DataFrame) -> DataFrame:
    """Documents that need work; a short list of ids goes to the documents."""
    touched = diff.where(F.col("status").isin(NEW, CHANGED)).select("doc_id")
    return docs.join(touched, "doc_id", "left_semi")


def removed_documents(current: DataFrame, manifest: DataFrame) -> DataFrame:
    gone = manifest.where(F.startswith("doc_id", F.lit("file:")))
    return gone.join(current.select("doc_id"), "doc_id", "left_anti")


def stale_chunk_ids(diff: DataFrame, manifest: DataFrame) -> DataFrame:
    """The chunk ids of the records that were replaced or removed."""
    gone = diff.where(F.col("status").isin(CHANGED, REMOVED)).select("doc_id")
    return manifest.join(gone, "doc_id", "left_semi").select(F.explode("chunk_ids").alias("chunk_id"))


def apply_chunks(chunks: DataFrame, diff: DataFrame, manifest: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table after the run: stale ids out, new rows in.  Chunk ids are
    unique, so the anti-join has no heavy key even for a very large document."""
    left = chunks.join(stale_chunk_ids(diff, manifest), "chunk_id", "left_anti")
    return left.unionByName(new_chunks, allowMissingColumns=True)


def superseded(diff: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(doc_id, indexed_in)`` of the records this run replaces or removes."""
    gone = diff.where(F.col("status").isin(CHANGED, REMOVED)).select("doc_id")
    return manifest.select("doc_id", "indexed_in").join(gone, "doc_id", "left_semi")


def live_chunks(chunk_log: DataFrame, dead: DataFrame) -> DataFrame:
    """Current chunks of an append-only log: all but those of superseded records.

    The dead records are few beside the chunks; measured so, they travel to the
    chunks, which are then read without a shuffle.
    """
    return chunk_log.join(F.broadcast(dead) if is_small(dead) else dead.hint("merge"), ["doc_id", "indexed_in"], "left_anti")


def manifest_from(records: DataFrame, chunks: DataFrame, diff: DataFrame, manifest: DataFrame,
                  indexed_at: Column, indexed_in: int) -> DataFrame:
    """Next manifest from ``records`` (source documents with a ``readable`` flag
    in place of the text) and the chunks made in this run.

    Untouched records stay, documents with chunks get a record, a changed
    document without text gets one with no chunks, a document that could not be
    read gets none and is tried again.
    """
    touched = diff.where(F.col("status").isin(NEW, CHANGED, REMOVED)).select("doc_id")
    untouched = manifest.join(touched, "doc_id", "left_anti")
    fields = [c for c in manifest.columns if c not in ("chunk_ids", "indexed_at", "indexed_in")]
    worked = (diff.where(F.col("status").isin(NEW, CHANGED)).select("doc_id", "status")
              .join(records.select(*fields, "readable"), "doc_id")
              .join(chunk_lists(chunks), "doc_id", "left")
              .where(F.col("chunk_ids").isNotNull()
                     | ((F.col("status") == CHANGED) & F.col("readable"))))
    fresh = worked.select(
        *fields,
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        indexed_at.alias("indexed_at"), F.lit(indexed_in).cast("long").alias("indexed_in"))
    return untouched.select(*fresh.columns).unionByName(fresh)


def run_report(diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per action.  A document to index without chunks is SKIPPED."""
    made = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("made"))
    old = F.coalesce("n_old_chunks", F.lit(0))
    indexed = F.col("status").isin(NEW, CHANGED)
    action = (F.when(indexed & F.col("made").isNull(), F.lit("SKIPPED"))
              .when(indexed, F.lit("LOADED")).otherwise(F.col("status")))
    return (diff.join(made, "doc_id", "left")
            .groupBy(action.alias("action"))
            .agg(F.count(F.lit(1)).alias("documents"),
                 F.sum(F.coalesce("made", F.lit(0))).alias("chunks_added"),
                 F.sum(F.when(F.col("status").isin(CHANGED, REMOVED), old).otherwise(0))
                 .alias("chunks_deleted")))
