"""Fetched pages to corpus text, and from there into the chunk store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import MAX_PAGES
from lorespan.functions.urls import trim_slashes
from lorespan.operators.webpages import (
    crawl_order, dump_header, link_edges, page_blocks, parse_pages,
)
from lorespan.plans.indexing import ChunkStore, index_documents
from lorespan.session import cut_lineage


def site_text(pages: DataFrame, seeds: DataFrame, domain: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """``pages(url, html)`` and ``seeds(pos, url)`` to ``(n, block)`` in visiting order.

    Every page is parsed once; the visit order is found on its links alone.
    """
    parsed = cut_lineage(parse_pages(
        pages.withColumn("url", trim_slashes(F.col("url"))), domain))
    order = crawl_order(seeds, link_edges(parsed), max_pages)
    visited = parsed.join(order.select("url", "visit"), "url")
    return page_blocks(visited, "visit")


def dump_document(blocks: DataFrame, name: str, heading: str, source: str, now: datetime) -> DataFrame:
    """The page dump as one source document, as long as its budget of pages allows.

    The crawl time stands in the header, so it would make every run a change; the
    hash is taken over the pages alone.
    """
    text = blocks.agg(
        F.count(F.lit(1)).alias("pages"),
        F.expr("listagg(block, '') within group (order by n)").alias("body")).where("pages > 0")
    return text.select(
        F.lit(f"file:{name}").alias("doc_id"), F.lit("website").alias("source_type"),
        F.lit(source).alias("source_url"), F.lit(heading).alias("title"),
        F.lit(None).cast("string").alias("file_path"), F.lit(now).alias("updated_at"),
        F.sha2("body", 256).alias("hash"), F.lit("public").alias("permission_scope"),
        F.struct(F.lit(name).alias("filename"), F.lit("txt").alias("extension"),
                 F.octet_length("body").cast("long").alias("size_bytes")).alias("extra"),
        F.concat(dump_header(heading, source, now.isoformat(), F.col("pages")), "body").alias("text"),
        F.lit(None).cast("string").alias("reason"))


def refresh_site(pages: DataFrame, seeds: DataFrame, domain: str, store: ChunkStore, name: str,
                 heading: str, source: str, max_pages: int = MAX_PAGES,
                 now: datetime | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Visit order, dump and indexing in one go; run by an outside timer.

    When no page has content the store is left as it is.
    """
    now = now or datetime.now(timezone.utc)
    blocks = cut_lineage(site_text(pages, seeds, domain, max_pages))
    document = dump_document(blocks, name, heading, source, now)
    return index_documents(document, store, whole_listing=False, now=now, **options)
