"""Account intake and session lookup as table operations (no credentials)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import ACCOUNT_ID_PATTERN
from lorespan.functions.text import display_name, strip
from lorespan.operators.ordering import keep_first


def normalize_ids(requests: DataFrame, column: str = "student_id") -> DataFrame:
    """Trimmed lower-case id and whether it is allowed."""
    return (requests.withColumn(column, F.lower(strip(F.col(column))))
            .withColumn("valid", F.coalesce(F.col(column).rlike(ACCOUNT_ID_PATTERN), F.lit(False))))


def intake_accounts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new(arrival, student_id, display_name, created_at)``: valid ids not yet
    taken, the first request of each id wins."""
    valid = normalize_ids(new).where("valid").drop("valid")
    firsts = keep_first(valid, ["student_id"], [F.asc("arrival")])
    return (firsts.join(existing.select("student_id"), "student_id", "left_anti")
            .withColumn("display_name", display_name(F.col("display_name"), F.col("student_id")))
            .select("student_id", "display_name", "created_at"))


def active_sessions(sessions: DataFrame, accounts: DataFrame, now: int) -> DataFrame:
    """Sessions not yet expired with the account they belong to."""
    alive = sessions.where(F.col("expires_at") >= now)
    named = accounts.select(
        "student_id", display_name(F.col("display_name"), F.col("student_id")).alias("display_name"))
    return alive.join(named, "student_id")
