"""Sizes must not drop or change data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorespan.operators.querytext import dictionary_table, expand_joined, prepare_queries
from lorespan.operators.similarity import knn, vector_width
from lorespan.plans.indexing import ChunkStore, index_corpus
from lorespan.session import shared_dir
from lorespan.sources.corpus import TOO_LARGE, scan_corpus
from lorespan.streaming.indexing import start_indexing_stream


def test_unusable_vectors_take_no_place(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 5]))]) for i in range(40)]
    rows += [(100, [math.nan] * 5), (101, [1.0, None, 2.0]), (102, None), (103, [math.inf, 0.0]), (104, [])]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>")
    items, queries = df.repartition(5), df.withColumnRenamed("item_id", "query_id")
    forms = [sorted(tuple(r) for r in knn(items, queries, 6, **o).select("query_id", "item_id", F.round("score", 6), "rank").collect())
             for o in ({"method": "items"}, {"method": "queries"}, {"method": "grid", "cell_items": 7, "cell_queries": 5})]
    assert forms[0] == forms[1] == forms[2]
    per = {}
    for q, item, *_ in forms[0]:
        per.setdefault(q, []).append(item)
    assert set(per) == {*range(40), 104} and all(len(v) == 6 for v in per.values())
    assert not {i for v in per.values() for i in v} & {100, 101, 102, 103}
    assert vector_width(df) == 5


def test_forced_forms_are_measured(spark):
    big = spark.range(5).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(1.0), 1_000_000).alias("vec"))
    with pytest.raises(ValueError):
        knn(big, big.withColumnRenamed("item_id", "query_id"), method="items")


def test_both_expansions_agree(spark):
    entries = [("", ["everywhere"]), ("hello", ["hi", None]), ("world", None), ("WORLD", ["globe", "earth"]), (None, ["never"]),
               ("hello world", ["greeting"]), ("lo w", []), ("x", ["y"])]
    dictionary = dictionary_table(spark, [(k, s or []) for k, s in entries]).withColumn(
        "synonyms", F.when(F.col("keyword") == "world", F.lit(None)).otherwise(F.col("synonyms")))
    tied = dictionary.withColumn("key_order", F.lit(1))
    texts = ["hello world", "Hello", "", "x", "nothing", "a world of its own"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    for table in (dictionary, tied, dictionary.unionByName(dictionary), dictionary.where("keyword <> ''"), dictionary.limit(0)):
        for m in (1, 2, 5):
            inline, joined = (sorted(map(tuple, prepare_queries(queries, table, m=m, inline_keys=n).select("query_id", "variant", "q").collect()))
                              for n in (100, -1 if table.count() == 0 else 0))
            assert inline == joined
    assert expand_joined(queries.withColumnRenamed("text", "q"), dictionary.limit(0)).count() == 0


def test_a_file_that_grows_too_large_stays(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("first text")
    (folder / "b.txt").write_text("second text")
    store = ChunkStore(spark, str(tmp_path / "store"))
    index_corpus(spark, str(folder), store)
    (folder / "a.txt").write_text("a much longer text than before")
    (folder / "c.txt").write_text("a new file that is too long from the start")
    docs = scan_corpus(spark, str(folder), limit=20)
    assert docs.count() == 3
    report, skipped = index_corpus(spark, str(folder), store, limit=20)
    assert {r.doc_id: r.reason for r in skipped.collect()} == {"file:a.txt": TOO_LARGE, "file:c.txt": TOO_LARGE}
    assert {r.doc_id for r in store.manifest.read().collect()} == {"file:a.txt", "file:b.txt"}
    assert {r.text for r in store.current_chunks().collect()} == {"first text", "second text"}


def test_the_stream_reads_odd_names_and_keeps_loader_meta(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a b.txt", "x[1].txt", "y{2}.txt"):
        (folder / name).write_text(f"text of {name}")
    store = ChunkStore(spark, str(tmp_path / "store"))
    start_indexing_stream(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
    assert {r.text for r in store.current_chunks().collect()} == {f"text of {n}" for n in ("a b.txt", "x[1].txt", "y{2}.txt")}
    assert "loader_meta" in store.current_chunks().columns


def test_a_cluster_must_name_the_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
