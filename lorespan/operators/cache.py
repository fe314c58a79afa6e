"""Semantic answer cache as a table ``(seq, question, answer, vec, created_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorespan.fixed_values import CACHE_ENTRIES, CACHE_THRESHOLD, CACHE_TTL_SECONDS
from lorespan.operators.similarity import knn
from lorespan.operators.weighted_lists import list_search


def live(created_at: Column, now: int, ttl: int = CACHE_TTL_SECONDS) -> Column:
    """An entry exactly ``ttl`` seconds old still counts."""
    return F.lit(now) - F.coalesce(created_at, F.lit(0)) <= ttl


def cache_lookup(entries: DataFrame, queries: DataFrame, now: int,
                 threshold: float = CACHE_THRESHOLD, ttl: int = CACHE_TTL_SECONDS,
                 **knn_options) -> DataFrame:
    """``(query_id, hit, score, seq, answer)`` for every query.

    The best positive score wins, the oldest entry on a tie; it is a hit at or
    above the threshold when its answer is not empty.
    """
    fresh = entries.where(live(F.col("created_at"), now, ttl))
    best = knn(fresh.select(F.col("seq").alias("item_id"), "vec"), queries, 1, **knn_options)
    best = best.where("score > 0").select("query_id", F.col("item_id").alias("seq"), "score")
    found = best.join(fresh.select("seq", "answer"), "seq")
    accepted = (F.col("score") >= threshold) & (F.length("answer") > 0)
    return (queries.select("query_id").join(found, "query_id", "left")
            .withColumn("hit", F.coalesce(accepted, F.lit(False)))
            .select("query_id", "hit",
                    F.coalesce("score", F.lit(0.0)).alias("score"),
                    F.when(F.col("hit"), F.col("seq")).alias("seq"),
                    F.when(F.col("hit"), F.col("answer")).alias("answer")))


def cache_hits(entries: DataFrame, queries: DataFrame, now: int, threshold: float = CACHE_THRESHOLD,
               ttl: int = CACHE_TTL_SECONDS, width: int | None = None) -> DataFrame:
    """``(query_id, score, seq, answer)`` of the queries that hit, as ``cache_lookup`` finds them.

    Only entries that can reach the threshold meet a query, whatever the size of
    both sides; a miss has no row and no score.
    """
    fresh = entries.where(live(F.col("created_at"), now, ttl))
    best = list_search(fresh.select(F.col("seq").alias("item_id"), "vec"), queries, 1, threshold=threshold, width=width)
    answers = fresh.select("seq", "answer").where(F.length("answer") > 0)
    return best.select("query_id", "score", F.col("item_id").alias("seq")).join(answers, "seq").select(
        "query_id", "score", "seq", "answer")


def newest(entries: DataFrame, cap: int = CACHE_ENTRIES) -> DataFrame:
    """Newest ``cap`` entries; expired ones still take a place.  Each task keeps
    only its own newest, so no full sort is needed."""
    return entries.orderBy(F.desc("seq")).limit(cap)


def cache_append(entries: DataFrame, new: DataFrame, cap: int = CACHE_ENTRIES) -> DataFrame:
    """Add ``new(arrival, question, answer, vec, created_at)`` and keep the newest ``cap``.

    Only the newest ``cap`` of the arrivals can survive, so at most ``cap`` rows
    are numbered after the last known ``seq``.
    """
    last = entries.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).scalar()
    arrivals = new.orderBy(F.desc("arrival")).limit(cap)
    numbered = (arrivals.withColumn("_n", F.row_number().over(W.orderBy("arrival")))
                .withColumn("seq", (last + F.col("_n")).cast("long"))
                .select(*entries.columns))
    return newest(entries.unionByName(numbered), cap)


def cache_stats(entries: DataFrame, now: int, ttl: int = CACHE_TTL_SECONDS,
                threshold: float = CACHE_THRESHOLD) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(live(F.col("created_at"), now, ttl)).alias("valid"),
        F.lit(threshold).alias("threshold"))
