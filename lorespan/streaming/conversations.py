"""Rolling conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.fixed_values import DEFAULT_TITLE, MESSAGES_KEPT, TITLE_CHARS
from lorespan.functions.text import blank
from lorespan.operators.ordering import keep_first
from lorespan.sources.snapshots import Snapshots

_STATE = "turns array<bigint>, roles array<string>, texts array<string>, asked_turn bigint, asked string"


def conversation_stream(turns: DataFrame, keep: int = MESSAGES_KEPT) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to the changed conversations of each batch.

    The state of a conversation is its last ``keep`` messages, whatever the
    order or batch they came in, so it never grows.
    """

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, asked_turn, asked = [], -1, ""
        if state.exists:
            t, r, x, asked_turn, asked = state.get
            kept = list(zip(t, r, x))
        for part in rows:
            questions = part[part["role"] == "user"]
            if len(questions):
                last = questions.loc[questions["turn"].idxmax()]
                if last["turn"] >= asked_turn:
                    asked_turn, asked = int(last["turn"]), str(last["text"])
            part = part.nlargest(keep, "turn")
            kept += [(int(a), str(b), str(c)) for a, b, c in
                     part[["turn", "role", "text"]].itertuples(index=False)]
            kept = sorted(kept)[-keep:]
        columns = [list(c) for c in zip(*kept)] or [[], [], []]
        state.update((*columns, asked_turn, asked))
        title = asked.strip()
        title = f"{title[:TITLE_CHARS]}..." if len(title) > TITLE_CHARS else title or DEFAULT_TITLE
        yield pd.DataFrame({"conv_id": [key[0]], "title": [title], "turns": [columns[0]],
                            "roles": [columns[1]], "texts": [columns[2]]})

    key_type = turns.schema["conv_id"].dataType.simpleString()
    accepted = turns.where(~blank(F.col("text"))).select("conv_id", "turn", "role", "text")
    return accepted.groupBy("conv_id").applyInPandasWithState(
        update, f"conv_id {key_type}, title string, turns array<bigint>, roles array<string>, texts array<string>",
        _STATE, "update", GroupStateTimeout.NoTimeout)


def log_schema(key_type: str = "string") -> str:
    return (f"conv_id {key_type}, title string, turns array<bigint>, roles array<string>, "
            "texts array<string>, epoch bigint")


def start_conversation_stream(turns: DataFrame, log: Snapshots, checkpoint: str,
                              keep: int = MESSAGES_KEPT, once: bool = True,
                              every: str = "10 seconds") -> StreamingQuery:
    """Append each batch's changed conversations to ``log``; a repeated batch
    overwrites its own folder."""

    def run(batch: DataFrame, epoch: int) -> None:
        log.publish(batch.withColumn("epoch", F.lit(epoch).cast("long")), epoch + 1)

    writer = (conversation_stream(turns, keep).writeStream.outputMode("update")
              .foreachBatch(run).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def current_messages(log: DataFrame) -> DataFrame:
    """Newest state per conversation as ``(conv_id, turn, role, text)``."""
    newest = keep_first(log, ["conv_id"], [F.desc("epoch")])
    rows = F.arrays_zip("turns", "roles", "texts")
    return (newest.select("conv_id", F.explode(rows).alias("m"))
            .select("conv_id", F.col("m.turns").alias("turn"), F.col("m.roles").alias("role"),
                    F.col("m.texts").alias("text")))
