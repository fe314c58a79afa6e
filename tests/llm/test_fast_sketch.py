import random

import numpy as np
import pytest

from lorespan.llm.fast_sketch import BANDS, ROWS, band_keys, fast_sketches, near_duplicates
from tests.llm.test_jaccard_join import brute


def hashes(rng, n):
    return np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))


def test_every_coordinate_fills_and_follows_the_set_alone():
    rng = np.random.default_rng(3)
    sets = [hashes(rng, n) for n in (1, 2, 7, 60, 3000, 1, 900)]
    together = fast_sketches(sets, 128)
    assert (together != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    for s, row in zip(sets, together):
        assert (fast_sketches([s], 128)[0] == row).all()


@pytest.mark.parametrize("n", [6, 40, 700])
def test_coordinates_agree_as_often_as_sets_are_similar(n):
    rng = np.random.default_rng(n)
    share, found = [], []
    for _ in range(60):
        a = hashes(rng, n)
        b = np.unique(np.append(a[: max(1, int(n * .8))], hashes(rng, n // 10)))
        share.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        x, y = fast_sketches([a, b], BANDS * ROWS)
        found.append((x == y).mean())
    # The spread of one sketch is at most that of independent coordinates.
    assert abs(np.mean(found) - np.mean(share)) < .02
    assert np.std(np.array(found) - share) < 1.5 * np.sqrt(.25 / (BANDS * ROWS))


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(9)
    for n in (7, 20, 100, 1000):
        for _ in range(40):
            a = hashes(rng, n)
            b = a[: -max(1, int(len(a) * .15))]
            keys = band_keys(fast_sketches([a, b], BANDS * ROWS))
            assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("seed,n,percent", [(0, 1, 85), (1, 3, 85), (2, 5, 80), (3, 3, 90)])
def test_against_brute_force(spark, seed, n, percent):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghABC") + str(rnd.randrange(20)) for _ in range(rnd.randrange(3, 120))] for _ in range(6)]
    rows = []
    for i in range(250):
        words = list(rnd.choice(base))
        if rows and rnd.random() < .5:
            words = (rnd.choice(rows)[1] or "").split()
        for _ in range(rnd.randrange(5)):
            if words:
                words[rnd.randrange(len(words))] = f"z{rnd.randrange(50)}"
        if rnd.random() < .3:
            words = words[:max(0, len(words) - rnd.randrange(12))]
        rows.append((i * 3 % 250 if rnd.random() < .95 else 7, " \t".join(words) if rnd.random() > .02 else None))
    df = spark.createDataFrame([(*r, 1, "k", [1], 2) for r in rows],
                               "doc_id long, text string, id int, key string, bands array<int>, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, n, percent).collect())
    assert got == brute(rows, n, percent)


def test_a_group_of_loose_copies_is_exact(spark):
    """Copies of one text with more and more changed words: some link to it, some only to each other, most to none."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(words)
        for _ in range(i % 14):
            copy[rnd.randrange(150)] = f"x{rnd.randrange(10_000)}"
        rows.append((1000 - i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)


def test_nulls_empty_short_long_and_repeated_rows(spark):
    long = " ".join(f"v{i % 9973}" for i in range(60_000))
    rows = [(5, ""), (4, None), (3, "one two"), (2, "One  TWO"), (1, " \n "), (9, "one"), (8, "two one"),
            (20, long), (21, long + " tail"), (22, long), (22, long)]
    rows += [(None, "one two three four five six seven")] * 500 + [(None, "one two three four five six seven eight")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates(df, 3, 75).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert got[5] == (0, 5, True) and got[4] == (0, 4, True) and got[1] == (0, 1, True)
    assert got[3] == (1, 2, False) and got[2] == (1, 2, True) and got[9] == (1, 9, True) and got[8] == (1, 8, True)
    assert [got[i][1:] for i in (20, 21, 22)] == [(20, True), (20, False), (20, False)]
    assert {(r.component_id, r.kept) for r in out if r.doc_id is None} == {(None, True)}
    assert near_duplicates(df.limit(0)).collect() == []
    assert near_duplicates(df.selectExpr("cast(doc_id as int) doc_id", "text").where("doc_id < 10")).count() == 7
