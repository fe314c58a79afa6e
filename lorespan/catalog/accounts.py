"""Accounts and sessions from customers, orders and events."""

from pyspark.sql import functions as F

from lorespan.functions.clock import epoch_seconds
from lorespan.operators.accounts import active_sessions, intake_accounts, normalize_ids
from lorespan.session import load_table

NOW = 1_704_067_200 + 20 * 86_400
TTL = 7 * 86_400


def _requests(spark, d):
    """Orders as registrations; ids of pending orders carry a forbidden sign."""
    sign = F.when(F.col("o_orderstatus") == "P", F.lit("#")).otherwise(F.lit("-"))
    return load_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("arrival"),
        F.concat(F.lit("  Cust"), sign, "o_custkey", F.lit(" ")).alias("student_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("   ")).otherwise(F.col("o_orderpriority"))
        .alias("display_name"),
        F.col("o_orderkey").alias("created_at"))


def normalized_ids(spark, d):
    return normalize_ids(_requests(spark, d)).select("arrival", "student_id", "valid")


_REQUESTS = """
req AS (SELECT o_orderkey AS arrival,
               'cust' || CASE WHEN o_orderstatus = 'P' THEN '#' ELSE '-' END || o_custkey AS student_id,
               o_orderstatus <> 'P' AS valid,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS display_name
        FROM orders)"""
IDS_SQL = f"WITH {_REQUESTS} SELECT arrival, student_id, valid FROM req"


def new_accounts(spark, d):
    existing = load_table(spark, d, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("cust-"), "c_custkey").alias("student_id"))
    return intake_accounts(_requests(spark, d), existing)


NEW_SQL = f"""
WITH {_REQUESTS},
f AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY arrival) AS r FROM req WHERE valid)
SELECT student_id, coalesce(display_name, student_id) AS display_name, arrival AS created_at FROM f
WHERE r = 1 AND student_id NOT IN (SELECT 'cust-' || c_custkey FROM customer WHERE c_acctbal < 0)
"""


def live_sessions(spark, d):
    sessions = load_table(spark, d, "events").select(
        F.col("event_id").alias("token"), F.col("user_id").alias("student_id"),
        (epoch_seconds(F.col("ts")) + TTL).alias("expires_at"))
    accounts = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("student_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.col("c_name")).alias("display_name"))
    named = active_sessions(sessions, accounts, NOW)
    return named.select("token", "student_id", "expires_at", "display_name")


SESSIONS_SQL = f"""
SELECT event_id AS token, user_id AS student_id, epoch(date_trunc('second', ts))::BIGINT + {TTL} AS expires_at,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey::VARCHAR ELSE c_name END AS display_name
FROM events JOIN customer ON c_custkey = user_id
WHERE epoch(date_trunc('second', ts))::BIGINT + {TTL} >= {NOW}
"""

QUERIES = {
    "normalized_ids": (normalized_ids, IDS_SQL),
    "new_accounts": (new_accounts, NEW_SQL),
    "live_sessions": (live_sessions, SESSIONS_SQL),
}
