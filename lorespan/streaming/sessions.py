"""Session expiry by processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.fixed_values import SESSION_TTL_SECONDS


def session_stream(logins: DataFrame, ttl_seconds: float = SESSION_TTL_SECONDS) -> DataFrame:
    """``logins(token, student_id, created_at)`` (epoch seconds) to OPEN rows, and
    an EXPIRED row once a session's lifetime has passed; then its state is gone."""

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            student, expires = state.get
            state.remove()
            yield pd.DataFrame({"token": [key[0]], "student_id": [student],
                                "expires_at": [expires], "event": ["EXPIRED"]})
            return
        student, expires = state.get if state.exists else (None, None)
        for part in rows:
            last = part.loc[part["created_at"].idxmax()]
            ends = int(last["created_at"] + ttl_seconds)
            if expires is None or ends >= expires:
                student, expires = str(last["student_id"]), ends
        state.update((student, expires))
        left = expires * 1000 - state.getCurrentProcessingTimeMs()
        state.setTimeoutDuration(max(int(left), 1))
        yield pd.DataFrame({"token": [key[0]], "student_id": [student],
                            "expires_at": [expires], "event": ["OPEN"]})

    return logins.groupBy("token").applyInPandasWithState(
        update, "token string, student_id string, expires_at bigint, event string",
        "student_id string, expires_at bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
