import contextlib
import io
import random
import re

import numpy as np
import pytest

from lorespan.llm import jaccard_join
from lorespan.llm.components import components
from lorespan.llm.jaccard_join import _items, bitmap, bitmap_distance, parity, similar_components


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[j:j + n]) for j in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed,n,percent", [(0, 1, 60), (1, 4, 85), (2, 2, 80), (3, 5, 80)])
def test_against_brute_force(spark, seed, n, percent):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghABC") + str(rnd.randrange(20)) for _ in range(rnd.randrange(3, 120))] for _ in range(6)]
    rows = []
    for i in range(200):
        words = list(rnd.choice(base))
        if rows and rnd.random() < .5:
            words = (rnd.choice(rows)[1] or "").split()
        for _ in range(rnd.randrange(4)):
            if words:
                words[rnd.randrange(len(words))] = f"z{rnd.randrange(50)}"
        if rnd.random() < .3:
            words = words[:max(0, len(words) - rnd.randrange(12))]
        if rnd.random() < .2:
            words = words + base[0][:30]
        rows.append((i * 3 % 200 if rnd.random() < .95 else 7, " \t".join(words) if rnd.random() > .02 else None))
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, id int, key string")
    assert sorted(map(tuple, similar_components(df, n, percent).collect())) == brute(rows, n, percent)


def test_bitmaps_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 400):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.append(a[: rng.integers(0, size + 1)], rng.integers(0, 1 << 63, size // 3 + 1).astype(np.uint64)))
        assert bitmap_distance(bitmap(a), bitmap(b)) <= len(np.setxor1d(a, b))
        assert bitmap_distance(bitmap(a), bitmap(a)) == 0


def test_parities_never_exceed_the_distance():
    rng = np.random.default_rng(8)
    for size in (1, 30, 700):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.append(a[: size // 2 + 1], rng.integers(0, 1 << 63, 9).astype(np.uint64)))
        assert np.bitwise_count(parity(a).view(np.uint64) ^ parity(b).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_repeated_rows_are_one_set(spark):
    """A thousand rows without an id and with one text give one row of shingles, not a thousand."""
    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"]
    df = spark.createDataFrame([(None, t) for t in texts for _ in range(1000)], "doc_id long, text string")
    wanted = df.selectExpr("doc_id", "xxhash64(text) as hash").distinct().selectExpr("hash as id", "doc_id", "hash")
    assert _items(df, wanted, 5).count() == 2
    got = similar_components(df, 5, 80).groupBy("n_shingles", "component_id").count().collect()
    assert sorted(map(tuple, got), key=repr) == [(6, None, 1000), (7, None, 1000)]


def test_empty_null_and_short(spark):
    rows = [(5, ""), (4, None), (3, "one two"), (2, "One  TWO"), (1, " \n "), (9, "one"), (8, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()}
    assert got == {5: (0, 5), 4: (0, 4), 3: (1, 2), 2: (1, 2), 1: (0, 1), 9: (1, 9), 8: (1, 8)}
    assert similar_components(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (301, 300)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 300: 300, 301: 300}


def test_lists_are_counted_without_the_other_columns(spark, monkeypatch):
    """Before, the parities of a set travelled with each of its shingles to where lists are counted, and prefixes were written twice."""
    plans, written = [], []
    cut = jaccard_join.cut_lineage

    def recorded(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        plans.append(out.getvalue())
        written.append(df.columns)
        return cut(df)

    monkeypatch.setattr(jaccard_join, "cut_lineage", recorded)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, " ".join(f"w{(i // 2) * 40 + j}" for j in range(40)) + f" {'x' * (i % 2)}") for i in range(20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in similar_components(docs, 4, 85).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {i: i - i % 2 for i in range(20)}
    assert sum("prefix" in columns for columns in written) == 1
    lists = plans[next(i for i, columns in enumerate(written) if "rest" in columns)]
    dealt = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(item#", lists)
    assert dealt and not any("parity" in columns for columns in dealt)
