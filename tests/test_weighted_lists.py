import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators.cache import cache_hits, cache_lookup
from lorespan.operators.similarity import knn
from lorespan.operators.weighted_lists import list_search

ITEMS, QUERIES = "item_id int, vec array<float>", "query_id int, vec array<float>"


def sparse(n, width, entries, seed):
    """Few entries in each row, commoner coordinates first, as words in texts."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((n, width))
    for row in rows:
        row[rng.zipf(1.3, entries) % width] += 1
    return [(i, row.tolist()) for i, row in enumerate(rows)]


def weighted(rows):
    """Counts times the logarithm of how rare a coordinate is."""
    counts = np.array([v for _, v in rows])
    rare = np.log(len(counts) / np.maximum(1, np.count_nonzero(counts, axis=0)))
    return [(i, (row * rare).tolist()) for (i, _), row in zip(rows, counts)]


def listed(hits):
    return sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in hits.collect())


def test_best_k_equals_the_product(spark):
    items = spark.createDataFrame(sparse(300, 64, 12, 1), ITEMS)
    queries = spark.createDataFrame(sparse(80, 64, 6, 2), QUERIES)
    assert listed(list_search(items, queries, 5)) == listed(knn(items, queries, 5, method="items"))


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.92])
def test_threshold_equals_the_product_with_any_sign(spark, threshold):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (150, 6)).astype(float).tolist())]
    items, queries = spark.createDataFrame(rows, ITEMS), spark.createDataFrame(rows[:60], QUERIES)
    want = knn(items, queries, 4, method="items").where(F.col("score") >= threshold)
    assert listed(list_search(items, queries, 4, threshold=threshold)) == listed(want)


def test_unusable_zero_and_short_rows_copies_and_top_up(spark):
    nan = float("nan")
    rows = [(1, None), (2, [nan, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, [0.0, 2.0, 1.0]), (6, [])]
    rows += [(10 + i, [0.0, 1.0, 0.0]) for i in range(9)]          # most rows are copies
    items = spark.createDataFrame(rows, ITEMS).withColumn("score", F.lit("extra"))
    queries = spark.createDataFrame([(i, v) for i, v in rows if i != 6] + [(50, [0.0, 0.0, 0.0, 7.0])], QUERIES)
    got = listed(list_search(items, queries, 4))
    assert got == listed(knn(items, queries, 4, method="items"))
    assert [r[1:] for r in got if r[0] == 50] == [(3, 0.0, 1), (4, 0.0, 2), (5, 0.0, 3), (6, 0.0, 4)]


def test_empty_sides(spark):
    items, queries = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, [1.0])], QUERIES)
    assert listed(list_search(items, queries, 3)) == []
    some = spark.createDataFrame([(1, [1.0])], ITEMS)
    assert listed(list_search(some, queries.limit(0), 3, threshold=0.5)) == []


def test_options_are_checked(spark):
    items, queries = spark.createDataFrame([(1, [-1.0])], ITEMS), spark.createDataFrame([(1, [1.0])], QUERIES)
    with pytest.raises(ValueError, match="above 0"):
        list_search(items, queries, threshold=0.0)
    with pytest.raises(Exception, match="negative"):
        list_search(items, queries).collect()


@pytest.mark.parametrize("threshold", [None, 0.92])
def test_few_pairs_are_scored(spark, monkeypatch, threshold):
    """Counts the pairs that are scored, those for the first scores included."""
    from lorespan.operators import weighted_lists

    items = spark.createDataFrame(weighted(sparse(2000, 1024, 10, 3)), ITEMS)
    queries = spark.createDataFrame(weighted(sparse(200, 1024, 10, 4)), QUERIES)
    scored, exact = [], weighted_lists._scored

    def counted(pairs, *sides):
        scored.append(pairs.count())
        return exact(pairs, *sides)

    monkeypatch.setattr(weighted_lists, "_scored", counted)
    got = listed(list_search(items, queries, 3, threshold=threshold))
    want = knn(items, queries, 3, method="items")
    assert got == listed(want if threshold is None else want.where(F.col("score") >= threshold))
    assert sum(scored) < 2000 * 200 / 10


def test_no_cells_and_no_product_in_the_plan(spark, capsys):
    items = spark.createDataFrame(sparse(50, 16, 4, 6), ITEMS)
    queries = items.withColumnRenamed("item_id", "query_id")
    list_search(items, queries, 2, threshold=0.9).explain()
    plan = capsys.readouterr().out
    assert "CoGroup" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cache_hits_are_the_hits_of_the_lookup(spark):
    texts = sparse(120, 32, 5, 7)
    entries = spark.createDataFrame([(i, "" if i % 7 == 0 else f"a{i}", v, 10 * i) for i, v in texts],
                                    "seq int, answer string, vec array<float>, created_at int")
    queries = spark.createDataFrame([(i, v) for i, v in texts], QUERIES)
    for threshold in (0.6, 0.92):
        found = cache_lookup(entries, queries, 900, threshold, 800).where("hit").drop("hit")
        hits = cache_hits(entries, queries, 900, threshold, 800)
        assert sorted(map(tuple, hits.select(*found.columns).collect())) == sorted(map(tuple, found.collect()))
