"""Corpus folder as tables: listing, loading, identity and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.fixed_values import ALLOWED_TYPES
from lorespan.functions.identity import (
    base_name, doc_id, extension, plain_path, title_from_name,
)
from lorespan.functions.text import fold_newlines

TEXT_TYPES = ("txt",)
# A binary column value is an array in memory, so a larger file cannot be one row.
MAX_CONTENT_BYTES = 2_000_000_000
TOO_LARGE = "too large to read"


def type_glob(types=ALLOWED_TYPES) -> str:
    """File-name pattern for the types in any case; other files are never opened."""
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t) for t in types]
    return "*.{" + ",".join(either) + "}"


def with_content(files: DataFrame, limit: int = MAX_CONTENT_BYTES) -> DataFrame:
    """``files`` of the binary reader, of which those beyond the limit stay without content."""
    small = files.where(F.col("length") <= limit)
    large = files.where(F.col("length") > limit).drop("content")
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")).select(small.columns))


def list_files(spark: SparkSession, path: str, types=ALLOWED_TYPES) -> DataFrame:
    """Files of one folder (not below it) with an allowed extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", type_glob(types)).load(path)


def listing(files: DataFrame) -> DataFrame:
    """``(name, size, modified)`` of ``files(path, modificationTime, length)``, newest first."""
    return (files.select(base_name(F.col("path")).alias("name"), F.col("length").alias("size"),
                         F.unix_timestamp("modificationTime").alias("modified"))
            .orderBy(F.desc("modified"), F.asc("name")))


def list_documents(spark: SparkSession, path: str, types=ALLOWED_TYPES) -> DataFrame:
    """The listing of a folder; file contents are not read."""
    return listing(list_files(spark, path, types))


def source_records(files: DataFrame, root: str, source_type: str = "local_file",
                   permission_scope: str = "public", source_url: str | None = None,
                   title: str | None = None) -> DataFrame:
    """``files(path, modificationTime, length, content)`` to source documents."""
    path = plain_path(F.col("path"))
    name = base_name(path)
    made = title_from_name(name)
    return files.select(
        doc_id(path, root).alias("doc_id"),
        F.lit(source_type).alias("source_type"),
        F.lit(source_url).cast("string").alias("source_url"),
        (F.coalesce(F.nullif(F.lit(title), F.lit("")), made) if title else made).alias("title"),
        path.alias("file_path"),
        F.col("modificationTime").alias("updated_at"),
        # A file that cannot be read is told apart by what the listing says of it.
        F.coalesce(F.sha2("content", 256), F.sha2(F.concat_ws(":", F.lit(TOO_LARGE), "length", "modificationTime")
                                                  .cast("binary"), 256)).alias("hash"),
        F.lit(permission_scope).alias("permission_scope"),
        F.struct(name.alias("filename"), extension(name).alias("extension"),
                 F.col("length").alias("size_bytes")).alias("extra"),
        *[c for c in files.columns if c not in ("path", "modificationTime", "length")])


def load_text(records: DataFrame, loaders: dict[str, Callable[[Column, Column], Column]] | None = None
              ) -> DataFrame:
    """Replace ``content`` by ``text`` (null when there is none) and ``reason``.

    ``loaders`` maps a file type to a function of (path, content) that gives a
    text column; plain text is built in, other types have no text without one.
    """
    kind = F.col("extra.extension")
    raw = F.col("content").cast("string")
    plain = F.when(F.is_valid_utf8(raw), fold_newlines(raw))
    text, reason = F.lit(None).cast("string"), F.lit("no loader for this type")
    for name, loader in (loaders or {}).items():
        made = loader(F.col("file_path"), F.col("content"))
        text = F.when(kind == name, made).otherwise(text)
        reason = F.when(kind == name, F.when(made.isNull(), "no text")).otherwise(reason)
    is_text = kind.isin(*TEXT_TYPES) & ~kind.isin(*(loaders or {"": None}))
    text = F.when(is_text, plain).otherwise(text)
    reason = F.when(is_text, F.when(~F.is_valid_utf8(raw), "not valid UTF-8")).otherwise(reason)
    reason = F.when(F.col("content").isNull(), F.lit(TOO_LARGE)).otherwise(reason)
    return (records.withColumn("text", text).withColumn("reason", reason).drop("content"))


def scan_corpus(spark: SparkSession, path: str | list[str], root: str | None = None, types=ALLOWED_TYPES,
                loaders=None, limit: int = MAX_CONTENT_BYTES, **record_options) -> DataFrame:
    """Folder (or files) to source documents with text, one pass over the file contents.

    Every listed file gives a row; one of more than ``limit`` bytes has no text and
    says so in ``reason``.
    """
    files = with_content(list_files(spark, path, types), limit)
    records = source_records(files, root if root is not None else path, **record_options)
    return load_text(records, loaders)
