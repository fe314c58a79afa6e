import unicodedata

import pytest
from pyspark.sql import functions as F

from lorespan.fixed_values import INTENT_DEFAULT
from lorespan.functions import identity, text, urls
from lorespan.functions.embedding import bucket_of, cosine, embed
from lorespan.operators.answers import assemble_answers, split_thinking
from lorespan.operators.querytext import (
    dictionary_table, expand_inline, intent_of, prepare_queries,
)


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value", [
    "ＡＢＣ　ｄｅｆ", "a b c", "  tab\tnew\nline  ", "\x1c\x1fedge\x85", "ﬁ ½ ㍿", "", "plain"])
def test_normalize(spark, value):
    want = " ".join(unicodedata.normalize("NFKC", value).split())
    assert one(spark, value, text.normalize) == want


@pytest.mark.parametrize("value", ["  x ", "　x ", "\x1cx\x85", "\n\t", ""])
def test_strip(spark, value):
    assert one(spark, value, text.strip) == value.strip()


def test_map_characters(spark):
    assert one(spark, "籤證", lambda c: text.map_characters(c, "證籤", "证签")) == "签证"
    assert one(spark, "籤證", text.map_characters) == "籤證"


def test_clean_lines(spark):
    assert one(spark, " ab \nabc\n\n\n\n  padded line \nxy", text.clean_lines) == "abc\npadded line"


@pytest.mark.parametrize("value, title", [
    ("  hi ", "hi"), ("", "New chat"), ("x" * 40, "x" * 40), ("x" * 41, "x" * 40 + "..."),
    ("中" * 50, "中" * 40 + "...")])
def test_title(spark, value, title):
    assert one(spark, value, text.title_of) == title


def test_summary(spark):
    assert one(spark, " a \n b " + "y" * 40, text.summary_of) == ("a b " + "y" * 40)[:36] + "..."
    assert one(spark, "  ", text.summary_of) == "New chat"


@pytest.mark.parametrize("path, doc", [
    ("/root/kb/a_b.txt", "file:a_b.txt"), ("/root/kb/sub/x.txt", "file:sub/x.txt"),
    ("/root/kbx/a.txt", "file:/root/kbx/a.txt"), ("/else/a.txt", "file:/else/a.txt")])
def test_doc_id(spark, path, doc):
    assert one(spark, path, lambda c: identity.doc_id(c, "/root/kb")) == doc


@pytest.mark.parametrize("name, stem, ext", [
    ("a_b.txt", "a_b", "txt"), ("a.b.PDF", "a.b", "pdf"), ("none", "none", ""), (".hidden", ".hidden", "hidden")])
def test_names(spark, name, stem, ext):
    assert one(spark, name, identity.stem) == stem
    assert one(spark, name, identity.extension) == ext


@pytest.mark.parametrize("url, domain, skip, canonical", [
    ("https://www.site.org/a/", True, False, "https://www.site.org/a"),
    ("https://WWW.SITE.org/x#y", True, False, "https://WWW.SITE.org/x"),
    ("https://site.org:80/x", False, False, "https://site.org:80/x"),
    ("https://sub.site.org/", False, False, "https://sub.site.org"),
    ("https://www.www.site.org", False, False, "https://www.www.site.org"),
    ("https://site.org/Login?x", True, True, "https://site.org/Login?x"),
    ("https://site.org/a.PDF", True, True, "https://site.org/a.PDF"),
    ("https://site.org/a.pdf?x=1", True, False, "https://site.org/a.pdf?x=1"),
    ("https://site.org//#top", True, False, "https://site.org"),
    ("/relative", False, False, "/relative")])
def test_urls(spark, url, domain, skip, canonical):
    assert one(spark, url, lambda c: urls.on_site(c, "site.org")) is domain
    assert one(spark, url, urls.skipped) is skip
    assert one(spark, url, urls.canonical) == canonical


@pytest.mark.parametrize("a, b, want", [
    ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 2.0], [0.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 0.0),
    ([3.0, 4.0], [3.0], 0.6), ([-1.0], [1.0], -1.0)])
def test_cosine(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(
        cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == pytest.approx(want)


def test_embed(spark):
    row = one(spark, "Word word, 中文 x_y", lambda c: embed(c, 64))
    counts = {}
    for token in ["word", "word", "中文", "x", "y"]:
        counts[bucket_of(token, 64)] = counts.get(bucket_of(token, 64), 0) + 1
    norm = sum(v * v for v in counts.values()) ** 0.5
    assert {i: pytest.approx(v / norm) for i, v in counts.items()} == {i: v for i, v in enumerate(row) if v}
    assert one(spark, None, lambda c: embed(c, 8)) is None
    assert sum(one(spark, "", lambda c: embed(c, 8))) == 0


def test_own_model(spark):
    assert one(spark, "abc", lambda c: embed(c, model=lambda t: F.array(F.length(t).cast("float")))) == [3.0]


ENTRIES = [("visa", ["pass", "permit", "third"]), ("ADVICE", ["help", "tips"]), ("签证", ["visa", "pass"])]


def expand(query, entries, m):
    """Independent rule: keys in order, first m synonyms each, first m distinct candidates."""
    out = []
    for key, syn in entries:
        if key.lower() in query.lower():
            out += [f"{query} {s}".strip() for s in syn[:m]]
    seen = [c for i, c in enumerate(out) if c not in out[:i] and c != query]
    return seen[:m]


@pytest.mark.parametrize("m", [1, 2, 3])
@pytest.mark.parametrize("query", [
    "nothing", "renew VISA", "is it advisable", "advice on visa", "签证 怎么办", "my Advice"])
@pytest.mark.parametrize("inline", [0, 100])
def test_variants(spark, query, m, inline):
    rows = prepare_queries(spark.createDataFrame([(1, query)], "query_id int, text string"),
                           dictionary_table(spark, ENTRIES), m=m, inline_keys=inline)
    got = [r.q for r in rows.orderBy("variant").collect()]
    assert got == [query] + expand(query, ENTRIES, m)


def test_empty_dictionary(spark):
    assert one(spark, "x", lambda c: expand_inline(c, [])) == []


@pytest.mark.parametrize("query, label", [
    ("Public HOLIDAY calendar", "Searching Malaysian public holidays"),
    ("semester dates", "Searching academic calendar"), ("how to 续签", "Searching visa information"),
    ("hello", INTENT_DEFAULT), ("enrol to register", "Searching registration info")])
def test_intent(spark, query, label):
    assert one(spark, query, intent_of) == label


@pytest.mark.parametrize("raw, steps, answer", [
    ("__THINK__a__ENDTHINK__text", ["a"], "text"),
    ("x__THINK__ a \n b __ENDTHINK__y__THINK____ENDTHINK__z", ["a \n b"], "xyz"),
    ("open __THINK__ never closed", [], "open __THINK__ never closed"), ("", [], "")])
def test_split_thinking(spark, raw, steps, answer):
    row = split_thinking(spark.createDataFrame([(raw,)], "text string")).first()
    assert (row.steps, row.answer) == (steps, answer)


def test_assemble(spark):
    rows = [(1, 2, "world "), (1, 0, "__THINK__x__ENDTHINK__"), (1, 1, " hello "), (2, 0, "  "),
            (3, 5_000, "b"), (3, 4, "a")]
    got = assemble_answers(spark.createDataFrame(rows, "stream_id int, seq int, chunk string"))
    assert sorted(map(tuple, got.collect())) == [(1, "hello world"), (3, "ab")]
