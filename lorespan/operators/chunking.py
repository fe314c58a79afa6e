"""Documents to chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from lorespan.functions.identity import chunk_id
from lorespan.functions.splitter import split_text
from lorespan.functions.text import text_slices
from lorespan.operators.ordering import running_total
from lorespan.session import run_once, spread

CORE_FIELDS = ("source_type", "source_url", "title", "file_path", "updated_at", "permission_scope")


def chunk_texts(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators: Sequence[str] = SEPARATORS,
                length: Callable[[str], int] = len) -> Column:
    """``array<string>`` of chunks.  Only the text column goes to Python, and only a slice of it is held as strings."""
    separators = tuple(separators)

    @F.arrow_udf("array<string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_slices(batch):
                yield pa.array([[] if t is None else split_text(t, size, overlap, separators, length)
                                for t in texts.to_pylist()], pa.list_(pa.string()))

    return run_once(pieces)(text)


def chunk(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
          separators: Sequence[str] = SEPARATORS,
          length: Callable[[str], int] = len) -> DataFrame:
    """``docs(doc_id, hash, text, …)`` to one row per chunk; other columns are kept.

    Documents without text give no rows.  With a ``part_no`` column a document
    has many rows and the index runs on across its parts.
    """
    if size <= overlap:
        raise ValueError("overlap must be smaller than size")
    cut = spread(docs).withColumn("_chunks", chunk_texts(F.col("text"), size, overlap, separators, length))
    kept = [c for c in docs.columns if c != "text"]
    if "part_no" not in docs.columns:
        rows = cut.select(*kept, F.posexplode("_chunks").alias("chunk_index", "text"))
    else:
        counted = cut.select("doc_id", "part_no", F.size("_chunks").alias("_n"))
        before = running_total(counted, ["doc_id"], "part_no", "_n", "_before")
        rows = (cut.join(before.select("doc_id", "part_no", "_before"), ["doc_id", "part_no"])
                .select(*kept, "_before", F.posexplode("_chunks").alias("_i", "text"))
                .withColumn("chunk_index", (F.col("_before") + F.col("_i")).cast("int"))
                .drop("_before", "_i"))
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("hash")))


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Core fields and scalar extras as columns, missing text as ``""``.

    ``extra`` is a struct of scalars; ``loader_meta`` a string map whose keys get
    the ``loader_`` prefix.
    """
    out = chunks
    for name in CORE_FIELDS:
        if name in out.columns and dict(out.dtypes)[name] == "string":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    if "extra" in out.columns:
        scalar = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}
        for field in out.schema["extra"].dataType.fields:
            kind = field.dataType.simpleString()
            if kind in scalar:
                value = F.col("extra")[field.name]
                out = out.withColumn(
                    field.name, F.coalesce(value, F.lit("")) if kind == "string" else value)
        out = out.drop("extra")
    if "loader_meta" in out.columns:
        renamed = F.transform_keys("loader_meta", lambda k, v: F.concat(F.lit("loader_"), k))
        out = out.withColumn("loader_meta", F.transform_values(
            renamed, lambda k, v: F.coalesce(v, F.lit(""))))
    return out


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """``(doc_id, chunk_ids)`` in index order: the list a manifest record holds."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))
    return chunks.groupBy("doc_id").agg(
        F.transform(ordered, lambda c: c["chunk_id"]).alias("chunk_ids"))
