import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators.cache import cache_append, cache_lookup, cache_stats, newest
from lorespan.operators.retrieval import fill_prompt, merge_variants, render_context
from lorespan.operators.similarity import choose_method, knn

FORMS = [dict(method="items"), dict(method="queries"), dict(method="grid", cell_items=7, cell_queries=3),
         dict(method="auto"), dict(method="auto", broadcast_bytes=0), dict(method="lsh", bits=0, tables=2, cell_items=9)]


def brute(items, queries, k, exclude_self=False):
    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v
    out = set()
    for q, a in queries:
        scored = []
        for i, b in items:
            if exclude_self and i == q:
                continue
            m = min(len(a), len(b))
            s = float(np.dot(unit(np.array(a, float))[:m], unit(np.array(b, float))[:m]))
            scored.append((-round(s, 9), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def tables(spark, items, queries):
    return (spark.createDataFrame(items, "item_id int, vec array<float>").repartition(3),
            spark.createDataFrame(queries, "query_id int, vec array<float>").repartition(2))


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("exclude", [False, True])
def test_exact_forms(spark, form, exclude):
    rng = np.random.default_rng(1)
    base = rng.integers(-2, 3, size=(30, 4)).astype(float).tolist()   # many exact ties, a zero row
    base[5] = [0.0] * 4
    items = list(enumerate(base))
    queries = [(i, base[i]) for i in (0, 3, 5, 17)]
    a, b = tables(spark, items, queries)
    got = {(r.query_id, r.item_id, r["rank"]) for r in knn(a, b, 5, exclude_self=exclude, **form).collect()}
    assert got == brute(items, queries, 5, exclude)


@pytest.mark.parametrize("form", FORMS[:3])
def test_other_lengths_nulls_and_few_items(spark, form):
    items = [(1, [1.0, 0.0, 5.0]), (2, [1.0]), (3, None), (4, [0.0, 1.0])]
    queries = [(1, [1.0, 1.0]), (2, None), (3, [1.0, 1.0, 1.0, 1.0])]
    a, b = tables(spark, items, queries)
    got = {(r.query_id, r.item_id, r["rank"]) for r in knn(a, b, 6, **form).collect()}
    assert got == brute([i for i in items if i[1]], [q for q in queries if q[1]], 6)


def test_string_ids_and_two_keys(spark):
    items = spark.createDataFrame([("b", [1.0]), ("a", [1.0])], "item_id string, vec array<float>")
    queries = spark.createDataFrame([("q", 0, [2.0]), ("q", 1, [-2.0])],
                                    "query_id string, variant int, vec array<float>")
    for form in FORMS[:3]:
        rows = knn(items, queries, 1, query_keys=("query_id", "variant"), **form).collect()
        assert sorted((r.query_id, r.variant, r.item_id) for r in rows) == [("q", 0, "a"), ("q", 1, "a")]


def test_lsh_recall_and_hot_code(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 16) for i in range(200)]     # a third of all rows are copies
    a = spark.createDataFrame(rows, "item_id int, vec array<float>")
    b = a.withColumnRenamed("item_id", "query_id")
    exact = {(r.query_id, r.item_id) for r in knn(a, b, 6, method="items").collect()}
    near = {(r.query_id, r.item_id)
            for r in knn(a, b, 6, method="lsh", tables=8, bits=4, cell_items=50, cell_queries=40).collect()}
    assert len(near) == len(exact) and len(exact & near) / len(exact) > 0.85


def test_registered_lsh_recall(spark):
    """The registered query against the exact one, on the tables it reads."""
    from lorespan.catalog.similarity import approximate_neighbors, nearest_vectors

    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        exact, near = ({(r.vec_id, r.neighbor_id) for r in query(spark, folder).collect()}
                       for query in (nearest_vectors, approximate_neighbors))
        assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.9


def test_lsh_tops_up_short_queries(spark):
    items = [(i, [1.0, 0.01 * i]) for i in range(5)]
    a, b = tables(spark, items, [(0, [-1.0, -0.1]), (1, [1.0, 0.0])])
    for bits in (8, 58):
        got = {(r.query_id, r.item_id, r["rank"]) for r in knn(a, b, 5, method="lsh", tables=2, bits=bits).collect()}
        assert got == brute(items, [(0, [-1.0, -0.1]), (1, [1.0, 0.0])], 5)


@pytest.mark.parametrize("form", FORMS[:3] + FORMS[5:])
def test_many_copies(spark, form):
    """A third of the rows are copies of one vector."""
    rng = np.random.default_rng(8)
    items = [(i, rng.integers(1, 9, 3).astype(float).tolist()) for i in range(40)]
    items += [(100 + i, [1.0, 2.0, 3.0]) for i in range(20)]
    a, b = tables(spark, items, items)
    for exclude in (False, True):
        got = {(r.query_id, r.item_id, r["rank"]) for r in knn(a, b, 4, exclude_self=exclude, **form).collect()}
        assert got == brute(items, items, 4, exclude)


def test_merge_variants(spark):
    head = "p" * 100
    hits = spark.createDataFrame(
        [(1, 0, 1, "a", head + "one"), (1, 0, 2, "b", "other"), (1, 1, 1, "c", head + "two"),
         (1, 2, 1, "d", "third"), (2, 0, 1, "c", head + "two")],
        "query_id int, variant int, rank int, item_id string, text string")
    rows = sorted((r.query_id, r.n, r.item_id) for r in merge_variants(hits).collect())
    assert rows == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    assert merge_variants(hits, max_docs=1).count() == 2
    text = render_context(merge_variants(hits).where("query_id = 2"), ["item_id"]).first().context
    assert text == f'[Reference 1] Content: {head}two | Metadata: {{"item_id":"c"}}\n'


def test_auto_measures_the_shared_side(spark):
    wide = spark.createDataFrame([(0, [1.0]), (1, [1.0] * 1000)], "item_id int, vec array<float>")
    many = spark.createDataFrame([(i, [1.0]) for i in range(50)], "query_id int, vec array<float>")
    assert choose_method(wide, many, None, 16_000) == "items"
    assert choose_method(wide, many, None, 15_999) == "queries"      # two rows, but long ones
    assert choose_method(wide, many, None, 399) == "grid"
    assert choose_method(wide, many, 1000, 8 * 1000 * 10) == "items"


@pytest.mark.parametrize("seed", range(3))
def test_merge_variants_random(spark, seed):
    rng = np.random.default_rng(seed)
    hits = [(int(q), v, r, f"i{rng.integers(30)}") for q in range(4) for v in range(3) for r in range(1, 7)]
    rows = [(q, v, r, i, "x" * 99 + i[1] + i) for q, v, r, i in hits]       # prefixes repeat across ids
    want = []
    for q in range(4):
        seen, n = set(), 0
        for row in sorted(r for r in rows if r[0] == q):
            if row[4][:100] not in seen:
                seen.add(row[4][:100])
                n += 1
                want.append((q, n, row[3]))
    df = spark.createDataFrame(rows, "query_id int, variant int, rank int, item_id string, text string")
    assert sorted((r.query_id, r.n, r.item_id) for r in merge_variants(df).collect()) == sorted(want)


def test_prompt_is_filled_once(spark):
    row = fill_prompt("Q {input} C {context} E", spark.createDataFrame(
        [("what is {context}?", "facts {input}")], "q string, context string")).first()
    assert row.prompt == "Q what is {context}? C facts {input} E"


DAY = 86_400
ENTRY = "seq long, question string, answer string, vec array<float>, created_at long"


@pytest.mark.parametrize("form", FORMS[:3])
def test_cache_lookup(spark, form):
    now = 100 * DAY
    entries = spark.createDataFrame([
        (1, "a", "old", [1.0, 0.0], now - 7 * DAY - 1),      # one second too old
        (2, "a", "edge", [1.0, 0.0], now - 7 * DAY),         # exactly at the limit
        (3, "a", "tie", [2.0, 0.0], now),                    # same score, younger
        (4, "b", "", [0.0, 1.0], now),                       # best for its query, but empty
        (5, "b", "near", [0.1, 1.0], now),
        (6, "z", "zero", [0.0, 0.0], now)], ENTRY)
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [0.7, 0.72])],
        "query_id int, vec array<float>")
    got = {r.query_id: (r.hit, r.seq, r.answer) for r in cache_lookup(entries, queries, now, **form).collect()}
    miss = (False, None, None)
    assert got == {1: (True, 2, "edge"), 2: miss, 3: miss, 4: miss, 5: miss}


def test_cache_append_and_stats(spark):
    entries = spark.createDataFrame([(i, "q", "a", [1.0], 10) for i in range(1, 6)], ENTRY)
    new = spark.createDataFrame([(i, f"n{i}", "a", [1.0], 20) for i in range(4)],
                                "arrival long, question string, answer string, vec array<float>, created_at long")
    after = cache_append(entries, new, 6).orderBy("seq").collect()
    assert [(r.seq, r.question) for r in after] == [
        (4, "q"), (5, "q"), (6, "n0"), (7, "n1"), (8, "n2"), (9, "n3")]
    none = entries.limit(0)
    assert [r.seq for r in cache_append(none, new, 2).orderBy("seq").collect()] == [1, 2]
    assert tuple(cache_stats(entries, 25, ttl=15).first()) == (5, 5, 0.92)
    assert tuple(cache_stats(entries, 26, ttl=15).first()) == (5, 0, 0.92)
    assert newest(entries, 2).count() == 2
