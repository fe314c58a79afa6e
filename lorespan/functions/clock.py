"""Time expressions that read the same in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, read as UTC.

    ``unix_timestamp`` would read such a column in the session's zone.
    """
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400
            + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts))
