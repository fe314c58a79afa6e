"""Larger tables: folders of many files, sides beyond what is shared, long batches."""

import numpy as np
import pyarrow as pa
import __spark_entry__ as entry
from lorespan.functions.embedding import embed
from lorespan.functions.text import text_slices
from lorespan.operators import weighted_lists
from lorespan.operators.chunking import chunk_texts
from lorespan.operators import similarity
from lorespan.operators.similarity import knn

SMALL = "/root/testdata/sf0.001"


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/conversations.parquet").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = (sorted(map(tuple, entry.queries()["streamed_markers"](spark, d).collect())) for d in (str(tmp_path), SMALL))
    assert len(want) == 87 and got == want


def vectors(spark, n, width=8):
    rows = np.random.default_rng(4).integers(-3, 4, (n, width)).astype(float).tolist()
    items = spark.createDataFrame(list(enumerate(rows)), "item_id int, vec array<float>").repartition(3)
    return items, items.withColumnRenamed("item_id", "query_id")


def test_queries_beyond_the_limit_are_shared_in_parts(spark, monkeypatch):
    items, queries = vectors(spark, 200)
    want = sorted(map(tuple, knn(items, queries, 5, method="items", exclude_self=True).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 5000)
    got = knn(items, queries, 5, method="queries", exclude_self=True, broadcast_bytes=0)
    assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == want


def test_cells_do_not_copy_rows_without_end(spark):
    items, queries = vectors(spark, 600)
    cells = similarity._cells(*similarity._whole(items, queries, 7, 3, 1000), ["query_id"])
    assert [side.count() for side in cells] == [600 * similarity.FRAGMENTS] * 2
    cells = similarity._cells(*similarity._whole(items, queries, 7, 3, 40), ["query_id"])
    assert [side.count() for side in cells] == [600 * 15] * 2
    want = sorted(map(tuple, knn(items, queries, 5, method="items").collect()))
    got = knn(items, queries, 5, method="grid", cell_items=7, cell_queries=3)
    assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == want


def test_a_long_batch_is_read_in_slices(spark):
    texts = pa.array(["aaaa", None, "", "bb", "c" * 9, None, "d"])
    assert [part.to_pylist() for part in text_slices(texts, 6)] == [["aaaa", None, "", "bb"], ["c" * 9], [None, "d"]]
    assert list(text_slices(texts.slice(0, 0))) == []


def test_no_task_holds_a_batch_of_strings(spark, tmp_path):
    """Vectors and chunks of one batch come in several pieces, row for row."""
    rows = spark.range(40, numPartitions=1).selectExpr(
        "id", "if(id % 7 = 3, null, repeat(concat('word', id, ' '), if(id % 2 = 0, 40000, 3))) text")
    got = rows.select("id", "text", chunk_texts("text").alias("c"), embed("text").alias("v")).collect()
    assert sum(len(r.text or "") for r in got) > 3 * 1024 * 1024
    for r in got:
        assert (r.v is None) == (r.text is None) and (r.c == []) == (r.text is None)
        if r.text:
            assert r.c[0].startswith(f"word{r.id} ") and len(set(r.v)) == 2 and abs(max(r.v) - 1) < 1e-6


def test_lists_bring_few_pairs_together_and_lose_none():
    rng = np.random.default_rng(5)
    rows = np.zeros((500, 1024))
    for row in rows:
        row[rng.integers(0, 1024, 10)] += rng.uniform(0.5, 2, 10)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    for width, most in ((1024, 500 * 500 / 10), (4, 500 * 500)):      # entry by entry, and by the parts of all pairs
        few = unit[:, :width] if width == 1024 else np.abs(rng.standard_normal((500, 4)))
        few = few / np.linalg.norm(few, axis=1)[:, None]
        lists = weighted_lists.Lists(few, 0.3)
        met = {(int(a), int(b)) for row, col in weighted_lists.meet(lists, lists, np.full(500, 0.3)) for a, b in zip(row, col)}
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(few @ few.T >= 0.3))} <= met
        assert len(met) <= most


def test_only_the_best_of_each_query_leave_a_task(spark, monkeypatch):
    """Before, every pair that met was written together with both of its vectors."""
    rows = np.random.default_rng(6).uniform(0.1, 1, (300, 16)).tolist()       # every pair meets
    items = spark.createDataFrame(list(enumerate(rows)), "item_id int, vec array<float>").repartition(2)
    queries, left, kept = items.withColumnRenamed("item_id", "query_id"), [], weighted_lists._scored

    def counted(pairs, *more):
        left.append(pairs.count())
        return kept(pairs, *more)

    monkeypatch.setattr(weighted_lists, "_scored", counted)
    for shared in (1 << 22, 0):
        monkeypatch.setattr(weighted_lists, "SHARED_BYTES", shared)
        for threshold in (None, 0.5):
            got = weighted_lists.list_search(items, queries, 3, threshold=threshold, width=16)
            want = knn(items, queries, 3, method="items")
            assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == \
                sorted(map(tuple, want.collect()))
    assert max(left) <= 300 * 3 * 8


def test_queries_in_an_items_direction_meet_no_cell(spark, monkeypatch):
    """Before, every query met every item although nothing scores above 1; rounding to 1 and copies count too."""
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((120, 8))
    rows[60:80] = 3 * rows[:20]                                   # lower ids in the same direction
    rows[80:90] = rows[20:30] * (1 + 1e-5 * rng.standard_normal((10, 8)))    # scores that round to 1
    rows[90:100] = rows[30:40] * (1 + 1e-3 * rng.standard_normal((10, 8)))   # and some that do not
    rows[100] = 0
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "item_id int, vec array<double>")
    asked = np.concatenate([rows, rng.standard_normal((9, 8))])
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "query_id int, vec array<double>")
    want = sorted(map(tuple, knn(items, queries, 1, method="items").collect()))
    met, cells = [], similarity._by_cells

    def counted(a, b, *more):
        met.append(b.select("query_id" if "query_id" in b.columns else "_h1").distinct().count())
        return cells(a, b, *more)

    monkeypatch.setattr(similarity, "_by_cells", counted)
    got = knn(items, queries, 1, method="grid", cell_items=50, cell_queries=40)
    assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == want
    assert met == [10]                                            # the zero row and the nine others


def test_vectors_are_made_once(spark, tmp_path):
    """Before, the grid made each query's vector three times."""
    from pyspark.sql import functions as F

    def slow(x):
        (tmp_path / f"{x}-{np.random.default_rng().integers(1 << 60)}").touch()
        return [float(x % 7), 1.0, float(x % 5)]

    made = F.udf(slow, "array<double>").asNondeterministic()
    queries = spark.range(40).select(F.col("id").alias("query_id"), made("id").alias("vec"))
    items = spark.range(100, 130).select(F.col("id").alias("item_id"), made("id").alias("vec"))
    assert knn(items, queries, 1, method="grid", width=3).count() == 40
    assert len(list(tmp_path.iterdir())) == 70


def test_a_crawl_asks_the_skip_rule_of_found_urls_only(spark, monkeypatch, tmp_path):
    """Before, every link was asked, and a level read and compared the URLs of all pages that hold links."""
    from pyspark.sql import functions as F
    from lorespan.operators import webpages

    def rule(url):
        if url is not None:
            (tmp_path / url).touch()
            return "login" in url

    monkeypatch.setattr(webpages, "skipped", F.udf(rule, "boolean"))
    edges = [("a", 0, "b"), ("a", 1, "login"), ("b", 0, "c/"), ("b", 1, "a"), (None, 0, "d"), ("c", 0, None)]
    edges += [(f"x{n}", 0, f"x{n + 1}") for n in range(50)]
    for small in (True, False):
        monkeypatch.setattr(webpages, "is_small", lambda front, small=small: small)
        got = webpages.crawl_order(spark.createDataFrame([(0, "a/")], "pos int, url string"),
                                   spark.createDataFrame(edges, "src_url string, pos int, dst_url string"))
        assert [(r.level, r.url) for r in got.orderBy("visit").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c", "login"]


def test_a_crawl_tells_pages_apart_that_share_a_number(spark, monkeypatch):
    from pyspark.sql import functions as F
    from lorespan.operators import webpages

    marks = webpages._marks
    monkeypatch.setattr(webpages, "_marks", lambda url: [
        F.when(url.isNotNull(), F.lit(1).cast("long")).alias("_h1"), marks(url)[1]])
    got = webpages.crawl_order(spark.createDataFrame([(0, "a")], "pos int, url string"),
                               spark.createDataFrame([("a", 0, "b"), ("z", 0, "y")], "src_url string, pos int, dst_url string"))
    assert [r.url for r in got.orderBy("visit").collect()] == ["a", "b"]
