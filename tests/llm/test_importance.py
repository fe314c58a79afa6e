import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespan.llm.importance import find_cutoff, resample


def brute(docs, target, percent, least, buckets, longest):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, n_words, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[:percent * len(able) // 100])]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(drawn + [(*r, None) for r in left.elements()], key=repr)


@pytest.mark.parametrize("seed,longest,least,percent", [(0, 1, 20, 10), (1, 2, 5, 35), (2, 1, 0, 100)])
def test_against_brute_force(spark, seed, longest, least, percent):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wa", "être", "日本", "x9") for b in range(40)]
    text = lambda n: " ,\t"[rnd.randrange(3)].join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randrange(60))) for i in range(400)] + [(7, text(30)), (None, text(40)), (None, None), (900, ""), (901, None)]
    docs += [(None, "same words again and again " * 6)] * 60 + [(950, text(60_000))]
    target = [text(30).replace("日本", "x9") for _ in range(30)] + [None]
    df = spark.createDataFrame([(*d, 0, "s", 1) for d in docs], "doc_id long, text string, weight int, row string, n_words int").repartition(5)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, 500, longest)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, percent, least, 500, longest)


def test_empty_tables_and_small_draws(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "text string")
    assert resample(docs.limit(0), none).collect() == []
    assert sorted(r["rank"] is None for r in resample(docs, none).collect()) == [True, True]
    assert [r.doc_id for r in resample(docs, none, 100, 1).where("rank = 1").collect()] == [1]


@pytest.mark.parametrize("bracket", [0.0, 0.01, 1.0])
def test_the_bracket_holds_the_cutoff(spark, bracket):
    """Also where the first bracket misses, and where a third of the rows has one score."""
    rnd = random.Random(4)
    values = [rnd.randrange(-10**9, 10**9) for _ in range(3000)] + [5] * 1500
    df = spark.createDataFrame([(v,) for v in values], "score long").repartition(6).cache()
    for draw in (1, 2, 450, 1500, 2600, 4499, 4500):
        low, high, above = find_cutoff(df, draw, len(values), bracket)
        cut = sorted(values, reverse=True)[draw - 1]
        assert low <= cut <= high and above == sum(v > high for v in values)
    # A narrow bracket leaves nearly all rows unsorted.
    low, high, _ = find_cutoff(df, 100, len(values), 0.01)
    assert df.where(F.col("score").between(low, high)).count() < 0.06 * len(values)
