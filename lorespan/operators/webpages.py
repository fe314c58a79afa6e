"""Web pages: content, links, visiting order and the page dump."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import (
    CONTENT_SELECTORS, MAX_PAGES, MIN_CLEAN_CHARS, MIN_RAW_CHARS,
)
from lorespan.functions.html import parse_page
from lorespan.functions.text import clean_lines
from lorespan.functions.urls import canonical, on_site, skipped, trim_slashes
from lorespan.operators.ordering import number_rows
from lorespan.session import cut_lineage, is_small, run_once, spread, work_dir


# A level of at most this many URLs is broadcast to the links.


def _parsed(selectors: Sequence[str], min_chars: int):
    selectors = tuple(selectors)

    @F.pandas_udf("title string, raw string, links array<string>, error string")
    def parse(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = []
        for url, html in zip(urls, pages):
            try:
                rows.append((*parse_page(url, html, selectors, min_chars), None))
            except Exception as problem:  # one bad page must not stop the job
                rows.append((None, None, [], f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame(rows, columns=["title", "raw", "links", "error"])

    return run_once(parse)


def parse_pages(pages: DataFrame, domain: Column | str | None = None,
                selectors: Sequence[str] = CONTENT_SELECTORS,
                min_raw: int = MIN_RAW_CHARS, min_clean: int = MIN_CLEAN_CHARS) -> DataFrame:
    """``pages(url, html, …)`` gains ``title, content, links, error``.

    ``content`` is null for a page without enough text, which then has no links.
    Links are absolute, without fragment and trailing slash; with a ``domain``
    only its own are kept.
    """
    page = spread(pages).withColumn("_p", _parsed(selectors, min_raw)("url", "html"))
    # One element: the text is cleaned once for both the test and the result.
    content = F.transform(F.array(clean_lines(F.col("_p.raw"))),
                          lambda t: F.when(F.length(t) >= min_clean, t))[0]
    links = F.transform("_p.links", canonical)

    def wanted(link):
        ok = (F.length(link) > 0) & ~skipped(link)
        return ok if domain is None else ok & on_site(link, domain)

    none = F.array().cast("array<string>")
    kept = [c for c in pages.columns if c != "html"]
    return (page.withColumn("content", content)
            .select(*kept, F.col("_p.title").alias("title"), "content",
                    F.when(F.col("content").isNotNull(), F.filter(links, wanted))
                    .otherwise(none).alias("links"),
                    F.col("_p.error").alias("error")))


def link_edges(parsed: DataFrame) -> DataFrame:
    """``(src_url, pos, dst_url)`` of the pages that have content."""
    return parsed.select(F.col("url").alias("src_url"), F.posexplode("links").alias("pos", "dst_url"))


def _marks(url: Column) -> list[Column]:
    """128 bits of hash that stand for a URL; none without one."""
    return [F.when(url.isNotNull(), F.xxhash64(*more, url)).alias(name)
            for name, more in (("_h1", ()), ("_h2", (F.lit(7),)))]


def crawl_order(seeds: DataFrame, edges: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Visiting order of a first-in-first-out crawl: ``(visit, level, url)``.

    ``seeds(pos, url)`` then links in page order.  The queue is worked off one
    level at a time: a level is ordered by (visit number of the page holding the
    link, place of the link on it), the first occurrence of a URL counts, and
    URLs seen before are left out.  Skipped URLs cost no budget, every visited
    one does.  Each level is added to one folder, which is read as one table, so
    the plan of the last level is as short as that of the first and a lost
    executor repeats little.  A level of measured, moderate size is sent to the
    links; a larger one shuffles with them.  Runs a few jobs for each level.

    All links are read at each level, so the page that holds one is named by 128
    bits of hash, and whether a URL is skipped is asked of what a level finds only.
    """
    spark = seeds.sparkSession
    folder, schema = work_dir(spark, "visits"), "visit long, level int, url string"
    links = cut_lineage(spread(edges.select(
        *_marks(trim_slashes(F.col("src_url"))), F.col("pos").cast("long").alias("pos"),
        trim_slashes(F.col("dst_url")).alias("url"))))
    queue = seeds.select(F.lit(0).cast("long").alias("parent"), F.col("pos").cast("long").alias("pos"),
                         trim_slashes(F.col("url")).alias("url"))
    level, done = 0, 0
    while done < max_pages:
        firsts = queue.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("first"))
        # Named in the condition, the aggregate keeps it from being asked of every link.
        fetched = F.when(F.col("first").isNotNull(), ~skipped(F.col("url")))
        firsts = firsts.where(fetched).select("url", "first.parent", "first.pos")
        if level:
            seen = spark.read.schema(schema).parquet(folder).select("url")
            firsts = firsts.join(seen, "url", "left_anti")
        ranked = number_rows(firsts, "place", ["parent", "pos", "url"])
        (ranked.where(F.col("place") <= max_pages - done)
         .select((F.col("place") + done).alias("visit"), F.lit(level).alias("level"), "url")
         .write.mode("append").parquet(folder))
        now = spark.read.schema(schema).parquet(folder).where(F.col("level") == level)
        n = now.count()
        if n == 0:
            break
        done, level = done + n, level + 1
        front = now.select(F.col("visit").alias("parent"), *_marks(F.col("url")))
        front = F.broadcast(front) if is_small(front) else front.hint("merge")
        # One number to look a page up by, the other to tell it from those that share it.
        queue = (links.join(front.withColumnRenamed("_h2", "_h3"), "_h1")
                 .where(F.col("_h2").bitwiseXOR(F.col("_h3")) == 0).select("parent", "pos", "url"))
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def page_blocks(pages: DataFrame, order: str = "visit") -> DataFrame:
    """``(n, block)`` for the pages with content, numbered in visiting order."""
    numbered = number_rows(pages.where(F.col("content").isNotNull()), "n", [order])
    block = F.concat(
        F.lit("[Page "), F.col("n").cast("string"), F.lit("]\nURL: "), F.col("url"),
        F.lit("\nTitle: "), F.col("title"), F.lit("\n\n"), F.col("content"),
        F.lit("\n\n" + "-" * 60 + "\n\n"))
    return numbered.select("n", block.alias("block"))


def dump_header(heading: str, source: str, crawled_at: str, pages: Column) -> Column:
    return F.concat(F.lit(f"{heading}\nSource: {source}\nCrawled at: {crawled_at}\nTotal pages: "),
                    pages.cast("string"), F.lit("\n" + "=" * 80 + "\n\n"))


def write_dump(blocks: DataFrame, path: str, heading: str, source: str, crawled_at: str) -> None:
    """Text files in page order; the header comes first."""
    header = blocks.agg(F.count(F.lit(1)).alias("pages")).select(
        F.lit(0).cast("long").alias("n"),
        dump_header(heading, source, crawled_at, F.col("pages")).alias("block"))
    # The text writer ends each row with a line break of its own.
    row = F.left("block", F.length("block") - 1).alias("block")
    (header.unionByName(blocks).repartitionByRange("n").sortWithinPartitions("n")
     .select(row).write.mode("overwrite").text(path))
