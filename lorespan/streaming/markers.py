"""Thinking steps and answer text out of streamed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.fixed_values import THINK_CLOSE, THINK_OPEN


def _settled(buffer: str) -> int:
    """Characters before a possible marker start at the end of the buffer."""
    for n in range(min(len(THINK_OPEN) - 1, len(buffer)), 0, -1):
        if THINK_OPEN.startswith(buffer[-n:]):
            return len(buffer) - n
    return len(buffer)


def read_markers(buffer: str, last: bool) -> tuple[list[tuple[str, str]], str]:
    """Finished ``(kind, text)`` parts and what must wait for more chunks."""
    parts = []
    while (start := buffer.find(THINK_OPEN)) >= 0:
        stop = buffer.find(THINK_CLOSE, start + len(THINK_OPEN))
        if stop < 0:
            break
        parts.append(("answer", buffer[:start]))
        parts.append(("step", buffer[start + len(THINK_OPEN):stop].strip()))
        buffer = buffer[stop + len(THINK_CLOSE):]
    if last:
        parts.append(("answer", buffer))
        buffer = ""
    else:
        ready = start if start >= 0 else _settled(buffer)
        parts.append(("answer", buffer[:ready]))
        buffer = buffer[ready:]
    return [p for p in parts if p[1]], buffer


def marker_stream(chunks: DataFrame) -> DataFrame:
    """``chunks(stream_id, seq, chunk, last)`` to ``(stream_id, part, kind, text)``.

    A marker cut between chunks waits in the state; the row with ``last`` flushes
    what is left (an unclosed marker is answer text) and drops the state.
    """

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, emitted = state.get if state.exists else ("", 0)
        # Chunks of one stream in one batch are one answer's text: a small group.
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        last = bool(batch["last"].any())
        parts, buffer = read_markers(buffer + "".join(batch["chunk"]), last)
        if last:
            state.remove()
        else:
            state.update((buffer, emitted + len(parts)))
        yield pd.DataFrame({
            "stream_id": [key[0]] * len(parts), "part": range(emitted, emitted + len(parts)),
            "kind": [p[0] for p in parts], "text": [p[1] for p in parts]})

    key_type = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(
        update, f"stream_id {key_type}, part bigint, kind string, text string",
        "buffer string, emitted bigint", "append", GroupStateTimeout.NoTimeout)
