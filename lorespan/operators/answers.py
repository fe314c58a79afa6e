"""Streamed answers: thinking steps and answer text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import THINK_CLOSE, THINK_OPEN
from lorespan.functions.text import blank, strip

_STEP = f"(?s){THINK_OPEN}(.*?){THINK_CLOSE}"


def thinking_steps(text: Column) -> Column:
    """Trimmed, non-empty steps in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_STEP), 1), strip)
    return F.filter(found, lambda s: F.length(s) > 0)


def answer_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, _STEP, ""))


def split_thinking(rows: DataFrame, text: str = "text") -> DataFrame:
    return (rows.withColumn("steps", thinking_steps(F.col(text)))
            .withColumn("answer", answer_text(F.col(text))))


def assemble_answers(chunks: DataFrame) -> DataFrame:
    """``chunks(stream_id, seq, chunk)`` to one stripped answer per stream; thinking
    chunks are left out and streams without text give no row.

    Neighbouring chunks are joined in spans first, so the last step handles few
    long pieces even when one stream holds a large part of the rows.
    """
    span = 4_096
    text = chunks.where(~F.startswith("chunk", F.lit(THINK_OPEN)))
    spans = (text.groupBy("stream_id", F.floor(F.col("seq") / span).alias("part"))
             .agg(F.expr("listagg(chunk, '') within group (order by seq)").alias("piece")))
    whole = spans.groupBy("stream_id").agg(
        F.expr("listagg(piece, '') within group (order by part)").alias("answer"))
    return whole.withColumn("answer", strip(F.col("answer"))).where(~blank(F.col("answer")))
