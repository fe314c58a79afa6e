import random

import pytest
from pyspark.sql import functions as F

from lorespan.functions.html import parse_page
from lorespan.operators.webpages import (
    crawl_order, link_edges, page_blocks, parse_pages, write_dump,
)
from lorespan.plans.indexing import ChunkStore
from lorespan.plans.website import refresh_site, site_text

URL = "https://www.site.org/a/b"


def body(inner):
    return f"<html><head><title>T</title><script>x('</p>')</script></head><body>{inner}</body></html>"


@pytest.mark.parametrize("inner, text", [
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("<div>one</div><div>two</div>", "one\ntwo"),
    ("<div>one<br>two</div>", "one\ntwo"),
    ("<p>a <b>b</b>\n  c</p>", "a b c"),
    ("<p>a<p>b", "a\n\nb"),
    ("x &amp; y &lt;z&gt; &#20013;", "x & y <z> 中"),
    ("<ul><li>1<li>2</ul>", "1\n2"),
    ("<style>p{}</style>seen<script>no</script>", "seen"),
    ("<div><div><p>deep</p></div></div>after", "deep\n\nafter"),
])
def test_rendered_text(inner, text):
    assert parse_page(URL, body(inner), min_chars=0)[1] == text


def test_choice_of_content():
    long, longer = "x" * 301, "y" * 400
    assert parse_page(URL, body(f"<main>{'x' * 300}</main><article>{long}</article>"))[1] == long
    assert parse_page(URL, body(f"<article>{longer}</article><main>{long}</main>"))[1] == long
    assert parse_page(URL, body(f"<article>s</article><article>{long}</article>"))[1] == "s\n" + long
    assert parse_page(URL, body(f"<div class='a content b'>{long}</div><div id=app>{longer}</div>"))[1] == longer
    assert parse_page(URL, body("short"))[1] is None
    assert parse_page(URL, f"<article>{long}")[1] == long
    assert parse_page(URL, f"no tags at all {long}")[1] == f"no tags at all {long}"


def test_title():
    assert parse_page(URL, "<title> a\n &amp;  b </title><title>c</title>")[0] == "a & b"
    assert parse_page(URL, "<p>none")[0] == ""


def test_links(spark):
    hrefs = ["/x", "c#frag", "../d//", "https://SITE.org/up", "https://sub.site.org/no", "https://site.org:8080/no",
             "/login", "/f.PDF", "/f.pdf?x=1", "mailto:me@site.org", "#top", "", "https://site.org"]
    page = body("<p>" + "z" * 400 + "</p>" + "".join(f'<a href="{h}">l</a>' for h in hrefs))
    pages = spark.createDataFrame([(URL, page), ("https://site.org/s", body('short<a href="/x">l</a>')),
                                   (URL + "2", body("<p>" + "z" * 400 + '</p><a href="http://[bad">l</a>'))],
                                  "url string, html string")
    rows = {r.url: r for r in parse_pages(pages, "site.org").collect()}
    assert rows[URL].links == [
        "https://www.site.org/x", "https://www.site.org/a/c", "https://www.site.org/d", "https://SITE.org/up",
        "https://www.site.org/f.pdf?x=1", URL, "https://site.org"]
    assert rows["https://site.org/s"].content is None and rows["https://site.org/s"].links == []
    assert rows[URL + "2"].error and rows[URL + "2"].content is None


@pytest.mark.parametrize("kept", [199, 200])
def test_cleaned_length(spark, kept):
    page = body("<p>" + "z" * kept + "</p>" + "<p>yy</p>" * 60)
    row = parse_pages(spark.createDataFrame([(URL, page)], "url string, html string")).first()
    assert (row.content is not None) == (kept >= 200)


def crawl_model(seeds, links, max_pages):
    """Plain first-in-first-out crawl."""
    queue, visited, order = [u.rstrip("/") for u in seeds], set(), []
    while queue and len(order) < max_pages:
        url = queue.pop(0)
        if url in visited or "login" in url:
            continue
        visited.add(url)
        order.append(url)
        for link in links.get(url, []):
            if link not in visited and link not in queue:
                queue.append(link)
    return order


@pytest.mark.parametrize("seed, budget", [(0, 1), (1, 7), (2, 30), (3, 1000)])
def test_crawl_order(spark, seed, budget):
    rng = random.Random(seed)
    names = [f"u{i}" for i in range(40)] + ["u/login"]
    links = {n: [rng.choice(names) for _ in range(rng.randrange(5))] for n in names if rng.random() < 0.8}
    links["u0"] = ["u0", "u1", "u1"]                       # itself and a duplicate
    seeds = ["u3/", "u0", "u/login", "u3", "gone"]        # gone has no page
    edges = [(s, p, d) for s, ds in links.items() for p, d in enumerate(ds)]
    got = crawl_order(spark.createDataFrame(list(enumerate(seeds)), "pos int, url string"),
                      spark.createDataFrame(edges, "src_url string, pos int, dst_url string"), budget)
    rows = got.orderBy("visit").collect()
    assert [r.url for r in rows] == crawl_model(seeds, links, budget)
    assert [r.visit for r in rows] == list(range(1, len(rows) + 1))


def test_site_to_dump(spark, tmp_path):
    def page(name, *links):
        return body(f"<main><p>{name} " + "w" * 400 + "</p></main>" + "".join(f'<a href="/{x}">l</a>' for x in links))
    pages = spark.createDataFrame([
        ("https://site.org/", page("home", "b", "a", "missing")), ("https://site.org/a", page("a", "c")),
        ("https://site.org/b", page("b")), ("https://site.org/c", page("c", "b")),
        ("https://site.org/island", page("island"))], "url string, html string")
    seeds = spark.createDataFrame([(0, "https://site.org/")], "pos int, url string")
    blocks = site_text(pages, seeds, "site.org")
    rows = blocks.orderBy("n").collect()
    assert [r.block.split("\n")[1] for r in rows] == [
        "URL: https://site.org", "URL: https://site.org/b", "URL: https://site.org/a", "URL: https://site.org/c"]
    assert [r.n for r in rows] == [1, 2, 3, 4]
    write_dump(blocks, str(tmp_path / "dump"), "Site", "https://site.org", "now")
    text = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))
    assert text.startswith("Site\nSource: https://site.org\nCrawled at: now\nTotal pages: 4\n" + "=" * 80)
    assert text.index("[Page 1]") < text.index("[Page 2]") < text.index("[Page 4]")


def test_refresh_site(spark, tmp_path):
    def site(text):
        return spark.createDataFrame([("https://site.org", body(f"<p>{text} " + "w " * 300 + "</p>"))],
                                     "url string, html string")
    seeds = spark.createDataFrame([(0, "https://site.org/")], "pos int, url string")
    store = ChunkStore(spark, str(tmp_path / "store"))

    def run(pages):
        report, _ = refresh_site(pages, seeds, "site.org", store, "site.txt", "Site", "https://site.org", dim=8)
        return {r.action: r.documents for r in report.collect()}

    assert run(site("one")) == {"LOADED": 1}
    assert run(site("one")) == {"UNCHANGED": 1}
    assert run(site("two")) == {"LOADED": 1}
    texts = [r.text for r in store.current_chunks().orderBy("chunk_index").collect()]
    assert texts[0].startswith("Site\nSource: https://site.org") and any("two w" in t for t in texts)
    assert run(site("two").limit(0)) == {"KEPT": 1}


def test_page_numbers_skip_empty_pages(spark):
    pages = spark.createDataFrame([(7, "u", "t", "c"), (9, "v", "t", None), (30, "w", "t", "d")],
                                  "visit long, url string, title string, content string")
    rows = page_blocks(pages).orderBy("n").collect()
    assert [(r.n, r.block.split("\n")[1]) for r in rows] == [(1, "URL: u"), (2, "URL: w")]
    assert rows[0].block == "[Page 1]\nURL: u\nTitle: t\n\nc\n\n" + "-" * 60 + "\n\n"


def test_edges(spark):
    parsed = spark.createDataFrame([("a", ["b", "c"]), ("d", [])], "url string, links array<string>")
    assert sorted(map(tuple, link_edges(parsed).collect())) == [("a", 0, "b"), ("a", 1, "c")]
