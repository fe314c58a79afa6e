"""Answer cache: conversations supply the entries, documents and messages the questions."""

from pyspark.sql import functions as F

from lorespan.catalog.sql import similarities, word_vectors
from lorespan.functions.clock import epoch_seconds
from lorespan.functions.embedding import DIM, with_vectors
from lorespan.operators.cache import cache_append, cache_hits, cache_lookup, cache_stats, newest
from lorespan.session import load_table

START = 1_704_067_200
NOW = START + 9 * 86_400
LOOSE = 0.6


def _entries(spark, d):
    """Each question with the answer in the following turn; older conversations come first."""
    said = load_table(spark, d, "conversations")
    asked = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = said.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    entries = asked.join(told, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "question", "answer",
        (F.lit(START) + F.col("conv_id") * 7200).alias("created_at"))
    return with_vectors(entries, "question")


_ENTRIES = f"""
    entry AS (SELECT a.conv_id * 1000 + a.turn AS seq, a.text AS question, b.text AS answer,
                     {START} + a.conv_id * 7200 AS created_at
              FROM conversations a JOIN conversations b
                ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
              WHERE a.role = 'user' AND b.role = 'assistant')"""


def _found(df):
    return df.select("query_id", "hit", F.round("score", 4).alias("similarity"),
                     F.col("seq").cast("long").alias("seq"), "answer")


def cached_answers(spark, d):
    """Every message of the conversations asked again, at the default threshold."""
    queries = with_vectors(load_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"))
    return _found(cache_lookup(_entries(spark, d), queries, NOW, width=DIM))


def cached_answers_loose(spark, d):
    """Every document as a question, at a lower threshold."""
    queries = with_vectors(load_table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"))
    return _found(cache_lookup(_entries(spark, d), queries, NOW, threshold=LOOSE, width=DIM))


def cached_hits(spark, d):
    """Every message, with the answer where weighted lists find one in the cache."""
    queries = with_vectors(load_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"))
    hits = cache_hits(_entries(spark, d), queries, NOW, width=DIM)
    return (queries.select("query_id").join(hits, "query_id", "left")
            .select("query_id", F.col("seq").isNotNull().alias("hit"), F.col("seq").cast("long").alias("seq"), "answer"))


def _lookup_sql(source, threshold):
    return f"""
WITH {_ENTRIES},
{word_vectors("v", f"SELECT seq AS id, question AS text FROM entry WHERE {NOW} - created_at <= 604800")},
{word_vectors("q", source)},
{similarities("s", "q", "v")},
best AS (SELECT q, arg_max(i, (score, -i)) AS seq, max(score) AS score FROM s WHERE score > 0 GROUP BY 1)
SELECT a.id AS query_id, coalesce(score >= {threshold} AND length(answer) > 0, false) AS hit,
       round(coalesce(score, 0), 4) AS similarity,
       CASE WHEN score >= {threshold} AND length(answer) > 0 THEN seq END AS seq,
       CASE WHEN score >= {threshold} AND length(answer) > 0 THEN answer END AS answer
FROM ({source}) a LEFT JOIN best ON q = a.id LEFT JOIN entry USING (seq)
"""


def _event_entries(spark, d):
    return load_table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("question"),
        F.col("props").alias("answer"), epoch_seconds(F.col("ts")).alias("created_at"))


EVENT_NOW = START + 20 * 86_400


def cache_statistics(spark, d):
    return cache_stats(_event_entries(spark, d), EVENT_NOW)


STATISTICS_SQL = f"""
SELECT count(*) AS total, count_if({EVENT_NOW} - epoch(date_trunc('second', ts))::BIGINT <= 604800) AS valid,
       0.92::DOUBLE AS threshold FROM events
"""


def newest_entries(spark, d):
    return newest(_event_entries(spark, d))


NEWEST_SQL = """
SELECT event_id AS seq, event_type AS question, props AS answer,
       epoch(date_trunc('second', ts))::BIGINT AS created_at
FROM events ORDER BY event_id DESC LIMIT 500
"""


def appended_entries(spark, d):
    """Error events arrive at a cache holding the other events."""
    rows = _event_entries(spark, d)
    old = rows.where("question <> 'error'")
    new = rows.where("question = 'error'").withColumnRenamed("seq", "arrival")
    return cache_append(old, new)


APPENDED_SQL = """
WITH e AS (SELECT event_id AS seq, event_type AS question, props AS answer,
                  epoch(date_trunc('second', ts))::BIGINT AS created_at FROM events),
old AS (SELECT * FROM e WHERE question <> 'error'),
new AS (SELECT (SELECT max(seq) FROM old)
               + least(500, count(*) OVER ()) - row_number() OVER (ORDER BY seq DESC) + 1 AS seq,
               question, answer, created_at FROM e WHERE question = 'error' ORDER BY e.seq DESC LIMIT 500)
SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new) ORDER BY seq DESC LIMIT 500
"""

QUERIES = {
    "cached_answers": (cached_answers, _lookup_sql(
        "SELECT conv_id * 1000 + turn AS id, text FROM conversations", 0.92)),
    "cached_hits": (cached_hits, "SELECT query_id, hit, seq, answer FROM (" + _lookup_sql(
        "SELECT conv_id * 1000 + turn AS id, text FROM conversations", 0.92) + ")"),
    "cached_answers_loose": (cached_answers_loose, _lookup_sql(
        "SELECT doc_id AS id, text FROM documents", LOOSE)),
    "cache_statistics": (cache_statistics, STATISTICS_SQL),
    "newest_entries": (newest_entries, NEWEST_SQL),
    "appended_entries": (appended_entries, APPENDED_SQL),
}
