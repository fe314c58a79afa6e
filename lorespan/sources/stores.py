"""Schemas of the stored tables, and import of a nested JSON conversation store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "doc_id string, source_type string, source_url string, title string, file_path string, "
    "updated_at timestamp, hash string, permission_scope string, "
    "extra struct<filename:string,extension:string,size_bytes:bigint>, "
    "chunk_ids array<string>, indexed_at timestamp, indexed_in bigint")
CHUNKS = (
    "doc_id string, chunk_id string, chunk_index int, text string, source_type string, "
    "source_url string, title string, file_path string, updated_at timestamp, hash string, "
    "permission_scope string, filename string, extension string, size_bytes bigint, "
    "loader_meta map<string,string>, vec array<float>, indexed_in bigint")
DEAD = "doc_id string, indexed_in bigint"
CACHE = ("seq bigint, question string, answer string, vec array<float>, created_at bigint")
MESSAGES = "conv_id string, turn bigint, role string, text string"
META = "conv_id string, title string, updated_at bigint, owner_id string, seq bigint"

_STORE = (
    "conversations map<string, array<struct<role:string, content:string>>>, "
    "meta map<string, struct<title:string, updated_at:bigint, student_id:string>>")


def read_conversation_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(meta, messages)`` from JSON files ``{"conversations": {id: […]}, "meta": {id: {…}}}``.

    The order of ids in a file is the order of creation.  A file that is not
    valid JSON counts as empty.
    """
    texts = spark.read.text(path, wholetext=True)
    store = texts.select(F.from_json("value", _STORE).alias("s"))
    meta = (store.select(F.posexplode("s.meta").alias("seq", "conv_id", "m"))
            .select("conv_id", "m.title", "m.updated_at",
                    F.coalesce("m.student_id", F.lit("")).alias("owner_id"),
                    F.col("seq").cast("long").alias("seq")))
    messages = (store.select(F.explode("s.conversations").alias("conv_id", "rows"))
                .select("conv_id", F.posexplode("rows").alias("turn", "m"))
                .select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role",
                        F.col("m.content").alias("text")))
    return meta, messages
