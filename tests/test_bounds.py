"""Products that are bounded first: the same best items, few whole products."""

import numpy as np
import pytest
from lorespan.operators import similarity, weighted_lists
from lorespan.operators.similarity import _Best, exact_scores, product_bounds


def unit(rows):
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.where(norms == 0, 1, norms)[:, None]


def texts(n, words, seed, width=256):
    """Counts of words, a few of them common in one of four languages, the others rare."""
    rng = np.random.default_rng(seed)
    common = rng.permutation(np.random.default_rng(1).permutation(width)[:40].reshape(4, 10))
    rows = np.zeros((n, width))
    for i, (size, mine) in enumerate(zip(rng.integers(3, words, n), rng.integers(0, 4, n))):
        np.add.at(rows[i], common[mine][rng.zipf(1.5, size) % 10], 1)
        np.add.at(rows[i], rng.integers(0, width, size), 1)
    return unit(rows)


def best(queries, items):
    ids = np.arange(len(items)) * 2 + 5
    held = _Best(1, len(queries))
    for half in np.array_split(np.arange(len(items)), 2):
        held.offer(queries, items[half], ids[half])
    return held, sorted(map(tuple, held.rows()[["q", "id", "score"]].to_numpy().tolist()))


def lowest_of_the_highest(queries, items):
    found = []
    for q in range(len(queries)):
        scores = exact_scores(queries, items, np.full(len(items), q), np.arange(len(items)))
        found.append((q, scores.argmax() * 2 + 5, scores.max()))
    return found


def test_few_whole_products_of_texts():
    """Before, every query was multiplied with every item."""
    queries, items = texts(4200, 250, 2), texts(9000, 30, 3)
    held, got = best(queries, items)
    assert held.products < len(queries) * len(items) / 4
    some = np.arange(0, len(queries), 60)
    assert [got[q][1:] for q in some] == [r[1:] for r in lowest_of_the_highest(queries[some], items)]


@pytest.mark.parametrize("kind", ["signed", "odd", "alike"])
def test_bounded_products_find_the_same(monkeypatch, kind):
    monkeypatch.setattr(similarity, "_MANY_ROWS", 10)
    monkeypatch.setattr(similarity, "_BOUND_ITEMS", 40)
    monkeypatch.setattr(similarity, "_BLOCK_QUERIES", 30)
    rng = np.random.default_rng(8)
    queries, items = rng.standard_normal((150, 70)), rng.standard_normal((400, 70))
    if kind == "odd":                                            # zero rows, copies, opposites, one entry
        items[::7], queries[::9] = 0, 0
        items[100:200] = items[:100]
        queries[50:100] = -3 * items[150:200]
        queries[100:120] = np.eye(70)[:20]
    if kind == "alike":                                          # all near one direction
        queries, items = queries * 1e-5 + 1, items * 1e-5 + 1
    queries, items = unit(queries), unit(items)
    assert best(queries, items)[1] == lowest_of_the_highest(queries, items)


@pytest.mark.parametrize("make", [texts, lambda n, words, seed: unit(np.random.default_rng(seed).standard_normal((n, 66)))])
def test_no_product_is_above_its_bound(make):
    queries, items = make(300, 200, 4), make(200, 20, 5)
    left, right = product_bounds(queries, items)
    assert left.shape[1] == right.shape[1] == 2 * (queries.shape[1] // 4)
    assert (left @ right.T >= queries @ items.T - 1e-5).all()


@pytest.mark.parametrize("width", [1, 6, 40, 64, 256])
@pytest.mark.parametrize("signed", [False, True])
def test_lists_keep_all_pairs_that_reach_the_threshold(width, signed):
    rng = np.random.default_rng(width)
    rows = rng.standard_normal((300, width)) * (rng.random((300, width)) < 0.5)
    rows[250:] = rows[:50] + 0.2 * rng.standard_normal((50, width))
    rows = unit(rows if signed else np.abs(rows))
    lists = weighted_lists.Lists(rows, 0.8)
    assert lists.parts.shape[1] == min(width, 64)
    met = {(a, b) for row, col in weighted_lists.meet(lists, lists, np.full(300, 0.8)) for a, b in zip(row.tolist(), col.tolist())}
    assert {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(rows @ rows.T >= 0.8)))} <= met


def test_few_pairs_of_texts_meet_at_the_threshold_of_the_cache():
    """Before, one pair in 9 met and was scored, as lists are full and 16 lengths tell little."""
    queries, items = (texts(1500, 60, seed)[:, np.random.default_rng(0).permutation(256)] for seed in (6, 7))
    order = np.argsort(np.count_nonzero(items, axis=0), kind="stable")
    wanted, held = (weighted_lists.Lists(rows[:, order], 0.92) for rows in (queries, items))
    met = sum(len(row) for row, _ in weighted_lists.meet(wanted, held, np.full(1500, 0.92)))
    assert np.count_nonzero(queries @ items.T >= 0.92) <= met < 1500 * 1500 / 20


def test_a_query_in_an_items_direction_meets_no_list(spark, monkeypatch):
    """Before, a message that is an entry itself met all other entries as well."""
    rows = texts(60, 20, 9)
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "item_id int, vec array<double>")
    asked = np.concatenate([3 * rows[:40], texts(5, 20, 10)])
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "query_id int, vec array<double>")
    met, shared = [], weighted_lists._by_shared

    def counted(items, asked, *more):
        met.append(asked.count())
        return shared(items, asked, *more)

    monkeypatch.setattr(weighted_lists, "_by_shared", counted)
    got = weighted_lists.list_search(items, queries, 1, threshold=0.92)
    want = similarity.knn(items, queries, 1, method="items").where("score >= 0.92")
    assert sorted(map(tuple, got.select("query_id", "item_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert met == [5]
