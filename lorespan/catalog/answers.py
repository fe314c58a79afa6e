"""Answer streams made of the conversations: one stream per message, with a thinking step."""

from pyspark.sql import functions as F

from lorespan.fixed_values import THINK_CLOSE, THINK_OPEN
from lorespan.operators.answers import assemble_answers, split_thinking
from lorespan.session import load_table


def raw_answers(spark, d):
    """Each message with a step before and one inside the text, and a blank step."""
    return load_table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit(f"{THINK_OPEN} Looking up "), "role", F.lit(f" ...{THINK_CLOSE}"),
                 F.replace("text", F.lit("\n"), F.lit(f"\n{THINK_OPEN}line{THINK_CLOSE}")),
                 F.lit(f"{THINK_OPEN} {THINK_CLOSE}")).alias("text"))


def thinking_split(spark, d):
    rows = split_thinking(raw_answers(spark, d))
    return rows.select("conv_id", "turn", F.array_join("steps", "|").alias("steps"), "answer")


SPLIT_SQL = """
SELECT conv_id, turn,
       'Looking up ' || role || ' ...' || repeat('|line', len(string_split(text, chr(10))) - 1) AS steps,
       regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS answer
FROM conversations
"""


def answer_chunks(spark, d):
    """Chunks as the answer service sends them: a step, then the text line by line."""
    said = load_table(spark, d, "conversations")
    lines = F.concat(F.array(F.lit(f"{THINK_OPEN}Searching{THINK_CLOSE}")), F.transform(
        F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n"))))
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"),
                       F.posexplode(lines).alias("seq", "chunk"))


def assembled_answers(spark, d):
    return assemble_answers(answer_chunks(spark, d))


ASSEMBLED_SQL = """
SELECT conv_id * 1000 + turn AS stream_id,
       regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS answer
FROM conversations WHERE trim(text, E' \\n') <> ''
"""

QUERIES = {
    "thinking_split": (thinking_split, SPLIT_SQL),
    "assembled_answers": (assembled_answers, ASSEMBLED_SQL),
}
