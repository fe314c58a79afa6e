"""Benchmark decontamination by a hash set of test n-grams; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 10
#: Bytes of benchmark text up to which its n-grams are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 4 * 1024 * 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, in text of either case; a word is a run of anything else.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with one space between; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " "))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """Equal wherever ``lowered`` is equal, and faster: the one letter whose lower
    case depends on its neighbours is made the same again."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def word_count(words: Column) -> Column:
    """The number of words of a spaced text."""
    return F.when(words == "", 0).otherwise(
        F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def test_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``item_id, window, width, block, gram, lead`` of each window of the items.

    A window is ``size`` words, or all of a shorter item.  Its grams are its runs of
    ``block`` words, half a window rounded up: every occurrence in a text, cut into
    blocks of that many words, covers one of the text's blocks whole.  ``lead`` is
    the number of words before the gram.
    """
    words = F.split(lowered(spaced(F.col("text"))), " ")
    items = (benchmark.select("item_id", words.alias("w")).where(F.col("w")[0] != "")
             .withColumn("width", F.least(F.size("w"), F.lit(size)))
             .withColumn("block", F.expr("int((width + 1) div 2)")))
    windows = items.select("item_id", "width", "block", F.explode(F.expr(
        "transform(sequence(1, size(w) - width + 1), i -> slice(w, i, width))")).alias("v")).distinct()
    return windows.select(
        "item_id", F.concat_ws(" ", "v").alias("window"), "width", "block", F.posexplode(F.expr(
            "transform(sequence(1, width - block + 1), i -> array_join(slice(v, i, block), ' '))"
        )).alias("lead", "gram")).withColumn("gram", folded(F.col("gram")))


def _bounded(benchmark: DataFrame) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, text_hash, start, width, item_id`` of each test window in a document.

    ``start`` counts words from 0.  Every document is cut into blocks of words; each
    block, with the block on either side, meets the broadcast test grams as it is
    read, and each meeting is verified word by word.  No text is shuffled unless the
    benchmark is too large to broadcast.
    """
    grams = test_windows(benchmark, size)
    blocks = [r[0] for r in grams.select("block").distinct().collect()]  # at most (size + 1) / 2 values
    wide = _bounded(benchmark)
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), spaced(F.col("text")).alias("w"))
    found = None
    for block in sorted(blocks):
        cut = F.regexp_extract_all("w", F.lit("[^ ]+(?: [^ ]+){0,%d}" % (block - 1)), F.lit(0))
        parts = text.where("w <> ''").withColumn("b", cut).select(
            "doc_id", "text_hash", F.posexplode(F.arrays_zip(
                F.col("b").alias("now"),
                F.expr("concat(array(cast(null as string)), b)").alias("before"),
                F.expr("slice(b, 2, size(b))").alias("after"))).alias("k", "p"))
        parts = parts.where("p.now is not null").select(
            "doc_id", "text_hash", "k", F.col("p.now").alias("now"), F.col("p.before").alias("before"),
            F.col("p.after").alias("after"), folded(F.col("p.now")).alias("gram"))
        side = grams.where(F.col("block") == block).drop("block")
        met = parts.join(F.broadcast(side) if wide else side, "gram")
        near = F.split(lowered(F.concat_ws(" ", "before", "now", "after")), " ")
        first = F.when(F.col("before").isNull(), 0).otherwise(block) - F.col("lead")
        met = (met.withColumn("first", first).where("first >= 0")
               .where(F.array_join(F.slice(near, F.col("first") + 1, F.col("width")), " ") == F.col("window"))
               .select("doc_id", "text_hash", (F.col("k") * block - F.col("lead")).cast("long").alias("start"),
                       F.col("width").cast("long").alias("width"), "item_id"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, start long, width long, item_id long")
    return found


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, text_hash, spans, items`` of each document that holds a test window.

    ``spans`` are disjoint ``(s, e)`` word ranges in order, ``items`` the items' ids
    as sorted strings.
    """
    found = occurrences(docs, benchmark, size)
    each = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("width")).alias("e")))).alias("r"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = F.expr("""
        aggregate(r, cast(array() as array<struct<s: bigint, e: bigint>>), (a, x) ->
            if(size(a) > 0 and x.s <= element_at(a, -1).e,
               concat(slice(a, 1, size(a) - 1),
                      array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))),
               concat(a, array(x))))""")
    return each.select("doc_id", "text_hash", spans.alias("spans"), "items")


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return docs.join(found, docs.doc_id.eqNullSafe(found._id) & (docs.text_hash == found._hash), "left").drop("_id", "_hash")


def scan_report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: how many of its words test windows cover, and whose.

    Null or wordless text has no words; repeated rows give repeated results; an
    empty benchmark hits nothing; a null item id hits words but is not listed;
    other columns of either table are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       word_count(spaced(F.col("text"))).alias("n_words"))
    out = _joined(rows, hits(docs, benchmark, size))
    n_hit = F.expr("coalesce(aggregate(spans, 0L, (n, x) -> n + x.e - x.s), 0L)")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without the words that test windows cover.

    A removed word takes what parts it from the next word along.  Documents with no
    hit are unchanged, and so are all other columns; a document of which no word is
    left goes.
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    out = _joined(keyed, hits(docs, benchmark, size).drop("items"))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)")
    out = out.where(F.col("spans").isNull() | (word_count(spaced(F.col("row.text"))) > n_hit))
    # The first gap stands before the first word, each other one after a word.
    words, gaps = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.split("row.text", WORD, -1)
    pairs = F.arrays_zip(words.alias("word"), F.slice(gaps, 2, F.size(words)).alias("gap"))
    kept = F.transform(pairs, lambda z, i: F.when(
        F.exists("spans", lambda x: (i >= x["s"]) & (i < x["e"])), "").otherwise(F.concat(z["word"], z["gap"])))
    text = F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))
    row = F.col("row")
    return out.select(F.when(F.col("spans").isNull(), row).otherwise(row.withField("text", text)).alias("row")).select("row.*")
