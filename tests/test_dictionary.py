"""Keywords inside texts: the automaton, the join by first characters, and plain containment agree."""

import random

import pytest

from lorespan.operators.querytext import dictionary_table, match_by_grams, match_dictionary


def contained(texts, entries):
    return sorted((i, t, o, k, tuple(s)) for i, t in texts if t is not None
                  for o, (k, s) in enumerate(entries) if k is not None and s is not None and k.lower() in t.lower())


def rows(df):
    return sorted((r.query_id, r.q, r.key_order, r.keyword, tuple(r.synonyms)) for r in df.collect())


ENTRIES = [("visa", ["permit"]), ("VISA", ["pass", "stay"]), ("visa", ["permit"]), ("is", ["x"]), ("", ["always"]),
           ("advisable", ["good"]), ("毕业", ["a"]), ("毕业证书", ["b"]), ("aa", ["c"]), ("aaa", []), ("İx", ["dot"]), ("\n", ["line"]), (" ", ["gap"])]
TEXTS = [(1, "An Advisable VISA"), (2, "aaaa"), (3, ""), (4, None), (5, "我的毕业证书"), (6, "a\nb"), (7, "advisa"), (8, "İX"), (8, "İX")]


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_empty_tied_and_overlapping_keys(spark, limit):
    queries = spark.createDataFrame(TEXTS, "query_id int, q string")
    table = dictionary_table(spark, ENTRIES)
    extra = spark.createDataFrame([(50, None, ["n"]), (51, "visa", None)], table.schema)
    distinct = [t for t in dict.fromkeys(TEXTS)] if not limit else TEXTS
    queries = queries.distinct() if not limit else queries
    got = rows(match_dictionary(queries, table.unionByName(extra), limit))
    # Lower case of a dotted capital is Spark's, so that text is compared apart.
    assert [r for r in got if r[0] != 8] == [r for r in contained(distinct, ENTRIES) if r[0] != 8]
    assert ("İx" in {r[3] for r in got if r[0] == 8})


def test_empty_sides(spark):
    queries = spark.createDataFrame(TEXTS, "query_id int, q string")
    table = dictionary_table(spark, ENTRIES)
    assert rows(match_dictionary(queries, table.limit(0))) == []
    assert rows(match_dictionary(queries.limit(0), table)) == []


def test_a_hundred_thousand_keywords(spark):
    rnd = random.Random(1)
    letters = "abcdefgh "
    keys = list({"".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 14))) for _ in range(100_000)})
    texts = [(i, "".join(rnd.choice(letters) for _ in range(400))) for i in range(40)] + [(99, "".join(rnd.choice(letters) for _ in range(60_000)))]
    table = spark.createDataFrame([(i, k, [f"s{i}"]) for i, k in enumerate(keys)], "key_order int, keyword string, synonyms array<string>")
    queries = spark.createDataFrame(texts, "query_id int, q string")
    found = match_dictionary(queries, table)
    assert "Generate explode" in found._jdf.queryExecution().simpleString() and "regexp_extract_all" not in found._jdf.queryExecution().simpleString()
    known = set(keys)
    want = sorted((i, k) for i, t in texts for k in {t[a:a + n] for n in range(4, 14) for a in range(len(t) - n + 1)} & known)
    assert sorted((r.query_id, r.keyword) for r in found.select("query_id", "keyword").collect()) == want
    some = queries.where("query_id < 5")
    assert rows(match_by_grams(some, table)) == rows(match_dictionary(some, table))
