"""Raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.decontamination import remove_spans
from lorespan.llm.jaccard_join import similar_rows
from lorespan.llm.packing import pack_documents
from lorespan.llm.pii import redact
from lorespan.llm.quality import keep_quality
from lorespan.session import cut_lineage, load_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality score rejects go."""
    return keep_quality(docs, load_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that five-word shingles connect at a similarity of 0.8, one stays: that with the smallest id.

    A row without an id stays where no other of its group has one, the one whose text has the least hash.
    Rows without words are in no group and all stay.
    """
    names = similar_rows(docs, size=5, percent=80).where("root is not null").groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = names.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n")).alias("f"))
    first = cut_lineage(first.select(F.col("f.doc_id").alias("first_id"), F.col("f.hash").alias("first_hash"), F.col("f.n").alias("copies")))

    def chosen(firsts: DataFrame) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(firsts["first_id"]) & (F.xxhash64(docs["text"]) == firsts["first_hash"])
        return docs.join(firsts, same, "left_semi")

    wordless = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = chosen(first.where("copies = 1")).unionByName(wordless)
    repeated = cut_lineage(first.where("copies > 1"))
    if not repeated.isEmpty():
        # Rows with one id and one text.
        row = F.struct(*docs.columns)
        unordered = any(kind in name for _, name in docs.dtypes for kind in ("map<", "variant"))
        rows = chosen(repeated).groupBy("doc_id", F.xxhash64("text")).agg(
            (F.min_by(row, F.to_json(row)) if unordered else F.min(row)).alias("row"))
        out = out.unionByName(rows.select("row.*"))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from the texts."""
    clean = remove_spans(docs, load_table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed; one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Trained models, components and token ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
