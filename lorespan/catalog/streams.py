"""Streaming jobs run to the end of the given tables; results equal the batch forms."""

from pyspark.sql import functions as F

from lorespan.catalog.conversations import KEPT_SQL
from lorespan.session import load_table, work_dir
from lorespan.sources.snapshots import Snapshots
from lorespan.sources.stores import CACHE
from lorespan.streaming.cache import start_cache_stream
from lorespan.streaming.conversations import current_messages, log_schema, start_conversation_stream
from lorespan.streaming.markers import marker_stream
from lorespan.fixed_values import THINK_CLOSE, THINK_OPEN


def _stream(spark, d, name):
    """The table's files as they arrive, whether it is one file or a folder of many."""
    schema = load_table(spark, d, name).schema
    # A stream takes a single file only as what a pattern matches.
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{d.rstrip('/')}/{name}.parque[t]"))


def streamed_conversations(spark, d):
    folder = work_dir(spark, "conversations")
    log = Snapshots(spark, f"{folder}/log", log_schema("bigint"))
    start_conversation_stream(_stream(spark, d, "conversations"), log, f"{folder}/checkpoint", 4).awaitTermination()
    return current_messages(log.read_all())


def streamed_markers(spark, d):
    """Messages with a thinking step per line, cut every seven characters."""
    folder = work_dir(spark, "markers")
    text = F.concat(F.replace("text", F.lit("\n"), F.lit(f"\n{THINK_OPEN}line{THINK_CLOSE}")), F.lit(" end"))
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7))
    chunks = (_stream(spark, d, "conversations").withColumn("text", text)
              .select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text",
                      F.explode(starts).alias("seq"))
              .select("stream_id", "seq", F.substring("text", F.col("seq") * 7 + 1, F.lit(7)).alias("chunk"),
                      (F.col("seq") == F.floor((F.length("text") - 1) / 7)).alias("last")))
    marked = marker_stream(chunks)
    query = (marked.writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/parts"))
    query.awaitTermination()
    parts = spark.read.schema(marked.schema).parquet(f"{folder}/parts")
    return parts.groupBy("stream_id").agg(
        F.expr("listagg(text, '') within group (order by part) filter (where kind = 'answer')").alias("answer"),
        F.count_if(F.col("kind") == "step").alias("steps"))


MARKERS_SQL = """
SELECT conv_id * 1000 + turn AS stream_id, text || ' end' AS answer,
       len(string_split(text, chr(10))) - 1 AS steps FROM conversations
"""

def streamed_cache(spark, d):
    """Events as answers arriving at an empty cache."""
    folder = work_dir(spark, "cache")
    store = Snapshots(spark, f"{folder}/entries", CACHE)
    answers = _stream(spark, d, "events").select(
        F.col("event_id").alias("arrival"), F.col("event_type").alias("question"), F.col("props").alias("answer"),
        F.unix_timestamp("ts").alias("created_at"))
    start_cache_stream(answers, store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select("seq", "question", "answer", "created_at")


STREAMED_CACHE_SQL = """
WITH e AS (SELECT event_id, event_type AS question, props AS answer, epoch(date_trunc('second', ts))::BIGINT AS created_at
           FROM events WHERE length(props) > 0 ORDER BY event_id DESC LIMIT 500)
SELECT row_number() OVER (ORDER BY event_id) AS seq, question, answer, created_at FROM e
"""


QUERIES = {
    "streamed_cache": (streamed_cache, STREAMED_CACHE_SQL),
    "streamed_conversations": (streamed_conversations, KEPT_SQL),
    "streamed_markers": (streamed_markers, MARKERS_SQL),
}
