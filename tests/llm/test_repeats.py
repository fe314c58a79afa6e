import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.llm.substring_dedup import remove_repeated_windows
from lorespan.llm.suffix_dedup import remove_repeated_bytes, repeated_starts


@given(st.lists(st.lists(st.sampled_from([0, 1, 97, 98, 255]), min_size=1, max_size=40).map(bytes), min_size=1, max_size=12),
       st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_interval_expansion_finds_every_repeat(strings, k):
    begins, repeated = repeated_starts(strings, k)
    seen, want, got = set(), [], []
    for begin, s in zip(begins, strings):
        for i in range(len(s) - k + 1):
            want.append(s[i:i + k] in seen)
            got.append(bool(repeated[begin + i]))
            seen.add(s[i:i + k])
    assert got == want and repeated.sum() == sum(want)


def brute_bytes(rows, k):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (text or "").encode()
        cover = [0] * len(b)
        for p in range(len(b) - k + 1):
            if b[p:p + k] in seen:
                cover[p:p + k] = [1] * k
            seen.add(b[p:p + k])
        spans = sum(c and not (p and cover[p - 1]) for p, c in enumerate(cover))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, k):
    split = [(-1 if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    first = {}
    for key, _, words in split:
        for p in range(len(words) - k + 1):
            w = tuple(words[p:p + k])
            first[w] = min(first.get(w, key), key)
    out = []
    for key, i, words in split:
        cover = [0] * len(words)
        for p in range(len(words) - k + 1):
            if first[tuple(words[p:p + k])] < key:
                cover[p:p + k] = [1] * k
        kept = " ".join(w for w, c in zip(words, cover) if not c)
        out.append((i, len(words), sum(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n, k):
    rnd = random.Random(seed)
    words = "a b c é dd eee \U0001f600".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 3 * k))) for _ in range(n)]
    made = []
    for i in range(n):
        kind = rnd.random()
        made.append(None if kind < .05 else base[rnd.randrange(n)] if kind < .35 else
                    base[rnd.randrange(n)] + "\tzz\n " + base[rnd.randrange(n)] if kind < .65 else
                    "xy " * rnd.randrange(4 * k) if kind < .75 else base[i])
    return made


@pytest.mark.parametrize("seed,k,ids", [(0, 12, 60), (1, 8, 20), (2, 2, 30), (3, 25, 60)])
def test_against_brute_force(spark, seed, k, ids):
    rows = [(i % ids, t) for i, t in enumerate(texts(seed, 60, k))] + [(None, "a b c " * 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, key int")
    got = remove_repeated_bytes(df, k).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, k)
    got = remove_repeated_windows(df, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, k)


def test_many_blocks_hot_copies_and_kept_text(spark):
    from pyspark.sql import functions as F

    from lorespan.llm.superkmers import ByteTokens, remove_repeats
    from lorespan.llm.suffix_dedup import _find

    rows = [(i, "the same long passage in many documents, " * 4) for i in range(150)] + list(enumerate(texts(5, 80, 20), 200))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, F.col("text"), ByteTokens, _find(30), 30, 12, with_kept=True, block_bytes=700).collect()
    assert sorted(((r.doc_id, r["size"], r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_bytes(rows, 30)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeated_bytes(df.limit(0)).count() == 0 and remove_repeated_windows(df.limit(0)).count() == 0


def test_periodic_long_text(spark):
    rows = [(1, "ab" * 30_000), (2, "w " * 20_000), (3, "w " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_bytes(df).collect()} == {1: 59_998, 2: 39_998, 3: 120}
    assert {r.doc_id: r.n_removed for r in remove_repeated_windows(df).collect()} == {1: 0, 2: 0, 3: 60}


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_hot_edges_and_rows_without_id_are_spread(spark, kind):
    """No bucket or block holds much more than its share, and the results are whole."""
    from pyspark.sql import functions as F

    from lorespan.llm import substring_dedup, suffix_dedup
    from lorespan.llm.superkmers import ByteTokens, WordTokens, remove_repeats

    k, m, block, find, tokens = ((30, 12, 4_000, suffix_dedup._find(30), ByteTokens) if kind == "bytes" else
                                 (10, 4, 8_000, substring_dedup._find(10), WordTokens))
    rnd = random.Random(4)

    def own():
        return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(1000)) for _ in range(14))

    passage = " ".join(f"p{i}q{i * 7}" for i in range(30))
    rows = [(None if i % 3 == 0 else i, f"{own()} {passage} {own()}") for i in range(800)]

    def bounded(strings, keys):
        assert sum(map(len, strings)) < 5 * block
        return find(strings, keys)

    class Bounded(tokens):
        def __init__(self, column):
            super().__init__(column)
            assert len(self.data) < 5 * block

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, F.col("text"), Bounded, bounded, k, m, block_bytes=block).collect()
    got = [(r.doc_id, r["size"], r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    if kind == "bytes":
        assert sorted(got, key=repr) == brute_bytes(rows, k)
    else:
        assert sorted(((*r[:3], r[4]) for r in got), key=repr) == brute_words(rows, k)
