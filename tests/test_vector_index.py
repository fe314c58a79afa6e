import numpy as np
import pytest

from lorespan.operators.similarity import knn
from lorespan.operators.vector_index import build_index, fit_centres, recall, search_index
from lorespan.session import load_table


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, vec array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = centres[rng.integers(0, 40, 3000)] + .25 * rng.normal(size=(3000, 24))
    rows[100:900] = rows[100]  # copies: a quarter of the rows
    return rows, frame(spark, rows, "item_id").repartition(5), frame(spark, rows[::60], "query_id")


def listed(hits):
    return sorted((r.query_id, r["rank"], r.item_id, r.score) for r in hits.collect())


def test_exact_search_equals_the_product(spark, clustered):
    _, items, queries = clustered
    index = build_index(items, cells=30, part_rows=200)
    seen = []
    got = listed(search_index(index, queries, 6, exact=True, probes=2, seen=seen))
    assert got == listed(knn(items, queries, 6))
    # Far cells are never read.
    assert sum(seen) < .7 * 50 * index.parts.sum()


def test_recall_and_work(spark, clustered):
    _, items, queries = clustered
    index = build_index(items, cells=40, part_rows=10_000)
    seen = []
    hits = search_index(index, queries, 6, seen=seen)
    assert recall(hits, knn(items, queries, 6)).first().recall > .9
    assert index.probes < 20 and len(seen) == 1 and seen[0] * 48 < .5 * 50 * 3000


def test_recall_on_the_given_vectors(spark):
    rows = load_table(spark, "/root/testdata/sf0.01", "embeddings")
    items = rows.selectExpr("vec_id as item_id", "embedding as vec")
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    assert recall(search_index(build_index(items), queries), knn(items, queries)).first().recall >= .9


def test_short_queries_read_on(spark):
    rng = np.random.default_rng(1)
    items = frame(spark, rng.normal(size=(40, 8)), "item_id")
    index = build_index(items, cells=20)
    got = search_index(index, frame(spark, rng.normal(size=(5, 8)), "query_id"), 30, probes=1).groupBy("query_id").count().collect()
    assert sorted(r["count"] for r in got) == [30] * 5


def test_unusable_and_zero_vectors(spark):
    rows = [[1, 0], [0, 0], None, [float("nan"), 1], [1, 1], [2, 2], []]
    items, queries = frame(spark, rows, "item_id"), frame(spark, [*rows, [1, 2, 3]], "query_id")
    index = build_index(items, cells=3, width=2)
    assert listed(search_index(index, queries, 3, exact=True)) == listed(knn(items, queries, 3, width=2))
    assert index.rows.count() == 5
    none = build_index(items.limit(0), width=2)
    assert search_index(none, queries, 3).count() == 0
    assert search_index(index, queries.limit(0), 3).count() == 0


def test_centres_of_few_distinct_rows():
    assert len(fit_centres(np.zeros((50, 3)), 8, 0)) == 1
