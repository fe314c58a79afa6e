"""Conversation store.  Messages come from ``conversations``; recency and owners
from ``events``, where a user's events of one type are a conversation."""

from pyspark.sql import functions as F

from lorespan.catalog.sql import collapse, strip
from lorespan.functions.clock import epoch_seconds
from lorespan.operators.conversations import (
    append_turns, detail, earlier_messages, history, list_for, prune, recent_messages,
    refresh_titles, save_turns, sidebar, titles,
)
from lorespan.operators.retrieval import with_history
from lorespan.session import load_table


def _said(spark, d):
    return load_table(spark, d, "conversations")


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


def _meta(spark, d):
    events = load_table(spark, d, "events")
    return events.groupBy(F.col("event_type").alias("owner_id"), "user_id").agg(
        F.max(epoch_seconds(F.col("ts"))).alias("updated_at"), F.min("event_id").alias("seq"),
    ).select(F.concat_ws(":", "owner_id", "user_id").alias("conv_id"), "owner_id", "updated_at", "seq",
             F.concat(F.lit("chat of "), "user_id").alias("title"))


_META = """
meta AS (SELECT event_type || ':' || user_id AS conv_id, event_type AS owner_id,
                max(epoch(date_trunc('second', ts))::BIGINT) AS updated_at, min(event_id) AS seq,
                'chat of ' || user_id AS title FROM events GROUP BY event_type, user_id)"""


def kept_messages(spark, d):
    return recent_messages(_said(spark, d), 4)


KEPT_SQL = """
SELECT conv_id, turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4
"""


def appended_messages(spark, d):
    """Answers arrive at a store holding the other messages."""
    said = _said(spark, d)
    return append_turns(said.where("role <> 'assistant'"), said.where("role = 'assistant'"), 3)


APPENDED_SQL = KEPT_SQL.replace("r <= 4", "r <= 3").replace(
    "FROM conversations)", "FROM conversations WHERE role <> 'assistant' OR trim(text) <> '')")


def _saved(spark, d):
    said = _said(spark, d)
    reply = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    owner = F.concat(F.lit("o"), F.col("conv_id") % 7)
    new = said.where("role = 'user'").join(reply, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.when(F.col("turn") % 5 == 4, "x").otherwise(owner).alias("owner_id"), F.col("text").alias("question"),
        "answer", (F.col("conv_id") * 10 + F.col("turn") + 1000).alias("asked_at"))
    meta = said.where("conv_id % 3 = 0").select(
        "conv_id", F.lit("old").alias("title"), F.col("conv_id").alias("updated_at"), owner.alias("owner_id"),
        F.col("conv_id").alias("seq")).distinct()
    return save_turns(meta, said.where("role = 'system'"), new, 3, 40)


def saved_turns(spark, d):
    """Conversations and messages after the turns of a day; some are of another's conversation."""
    meta, messages, _ = _saved(spark, d)
    shown = messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                                            lambda m: F.concat_ws(":", m["role"], m["text"])), "|").alias("messages"))
    return meta.drop("seq").join(shown, "conv_id", "left")


def refused_turns(spark, d):
    return _saved(spark, d)[2].select("conv_id", "turn", "owner_id")


_SAVED = """
WITH n AS (SELECT u.conv_id, u.turn, CASE WHEN u.turn % 5 = 4 THEN 'x' ELSE 'o' || (u.conv_id % 7) END AS owner_id,
                  u.text AS question, coalesce(a.text, '') AS answer, u.conv_id * 10 + u.turn + 1000 AS asked_at
           FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           WHERE u.role = 'user'),
m AS (SELECT DISTINCT conv_id, conv_id AS at, 'o' || (conv_id % 7) AS owner FROM conversations WHERE conv_id % 3 = 0),
f AS (SELECT conv_id, min_by(owner_id, turn) AS owner, min_by(asked_at, turn) AS at FROM n WHERE trim(question) <> '' GROUP BY 1),
o AS (SELECT conv_id, coalesce(m.owner, f.owner) AS owner_id, coalesce(m.at, f.at) AS at, m.owner IS NULL AS fresh FROM f FULL JOIN m USING (conv_id)),
ok AS (SELECT n.* FROM n JOIN o USING (conv_id, owner_id) WHERE trim(question) <> '')
"""
SAVED_SQL = f"""{_SAVED},
done AS (SELECT * FROM ok WHERE trim(answer) <> ''),
l AS (SELECT conv_id, max_by(trim(question), turn) AS q, max_by(asked_at, turn) AS at FROM done GROUP BY 1),
meta AS (SELECT conv_id, owner_id, coalesce(l.at, o.at) AS updated_at,
                coalesce(CASE WHEN length(q) > 40 THEN left(q, 40) || '...' ELSE q END, CASE WHEN fresh THEN 'New chat' ELSE 'old' END) AS title
         FROM o LEFT JOIN l USING (conv_id) ORDER BY updated_at DESC LIMIT 40),
said AS (SELECT conv_id, turn, 'user' AS role, trim(question) AS text FROM done
         UNION ALL SELECT conv_id, turn + 1, 'assistant', trim(answer) FROM done
         UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role = 'system'),
shown AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM said) WHERE r <= 3 GROUP BY 1)
SELECT conv_id, title, updated_at, owner_id, messages FROM meta LEFT JOIN shown USING (conv_id)
"""
REFUSED_SQL = f"{_SAVED} SELECT conv_id, turn, owner_id FROM n ANTI JOIN ok USING (conv_id, turn)"


def history_windows(spark, d):
    """The last two question-answer pairs."""
    return history(_said(spark, d), 2).select("conv_id", _flat(F.col("messages")).alias("messages"))


HISTORY_SQL = f"""
SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages FROM ({KEPT_SQL}) GROUP BY 1
"""


def message_lists(spark, d):
    """For the latest question of each conversation, what goes to the model."""
    said = _said(spark, d)
    asked = said.where("role = 'user'").groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("text", "turn").alias("q"))
    before = history(earlier_messages(said, asked))
    return with_history(asked, before).select("conv_id", _flat(F.col("messages")).alias("messages"))


MESSAGE_LISTS_SQL = """
WITH a AS (SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS q FROM conversations
           WHERE role = 'user' GROUP BY 1),
p AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY c.turn DESC) AS r
      FROM conversations c JOIN a USING (conv_id) WHERE c.turn < a.turn),
h AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS m FROM p WHERE r <= 10 GROUP BY 1)
SELECT conv_id, coalesce(m || '|', '') || 'user:' || q AS messages FROM a LEFT JOIN h USING (conv_id)
"""


def conversation_titles(spark, d):
    return titles(_said(spark, d))


TITLES_SQL = f"""
WITH t AS (SELECT conv_id, {strip('max_by(text, turn)')} AS l, {collapse('min_by(text, turn)')} AS f
           FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id,
       CASE WHEN length(l) > 40 THEN left(l, 40) || '...' WHEN l = '' THEN 'New chat' ELSE l END AS title,
       CASE WHEN length(f) > 36 THEN left(f, 36) || '...' WHEN f = '' THEN 'New chat' ELSE f END AS summary
FROM t
"""


def pruned_conversations(spark, d):
    """The 200 most recent conversations and how many events each keeps."""
    events = load_table(spark, d, "events").select(
        F.concat_ws(":", "event_type", "user_id").alias("conv_id"), "event_id")
    kept, messages = prune(_meta(spark, d), events)
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return kept.select("conv_id", "updated_at").join(counts, "conv_id")


PRUNED_SQL = f"""
WITH {_META},
k AS (SELECT conv_id, updated_at FROM meta ORDER BY updated_at DESC, seq LIMIT 200)
SELECT conv_id, any_value(updated_at) AS updated_at, count(*) AS n_messages
FROM k JOIN events e ON e.event_type || ':' || e.user_id = conv_id GROUP BY 1
"""


def owner_conversations(spark, d):
    rows = list_for(_meta(spark, d))
    return rows.withColumn("position", F.col("position").cast("long"))


OWNER_SQL = f"""
WITH {_META}
SELECT * FROM (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, seq) AS position,
                      conv_id, title, updated_at FROM meta) WHERE position <= 50
"""


def one_owner_conversations(spark, d):
    return list_for(_meta(spark, d), "error")


ONE_OWNER_SQL = f"""
WITH {_META} SELECT conv_id, title, updated_at FROM meta WHERE owner_id = 'error'
ORDER BY updated_at DESC, seq LIMIT 50
"""


def sidebar_lists(spark, d):
    updates = load_table(spark, d, "events").select(
        F.col("event_type").alias("owner_id"), F.col("user_id").alias("conv_id"),
        F.col("props").alias("title"), F.col("event_id").alias("ts"))
    rows = sidebar(updates)
    return rows.withColumn("position", F.col("position").cast("long"))


SIDEBAR_SQL = """
WITH l AS (SELECT event_type AS owner_id, user_id AS conv_id, max_by(props, event_id) AS title,
                  max(event_id) AS ts FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts DESC, conv_id DESC) AS position FROM l)
WHERE position <= 20
"""


def _owned(spark, d):
    """Conversations with the customer of the same number as their owner."""
    named = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("conv_id"), F.col("c_mktsegment").alias("owner_id"),
        F.col("c_name").alias("title"))
    return named


def conversation_details(spark, d):
    rows = detail(_owned(spark, d), _said(spark, d), "BUILDING")
    return rows.select("conv_id", "title", _flat(F.col("messages")).alias("messages"))


DETAILS_SQL = """
WITH m AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS m FROM conversations GROUP BY 1)
SELECT c_custkey AS conv_id, c_name AS title, coalesce(m, '') AS messages
FROM customer LEFT JOIN m ON conv_id = c_custkey WHERE c_mktsegment = 'BUILDING'
"""


def refreshed_titles(spark, d):
    local = _owned(spark, d).select("conv_id", "title")
    server = _said(spark, d).where("turn = 0").select(
        "conv_id", F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text")).alias("title"))
    return refresh_titles(local, server)


REFRESHED_SQL = """
SELECT c_custkey AS conv_id,
       coalesce(nullif(CASE WHEN role = 'system' THEN '' ELSE text END, ''), c_name) AS title
FROM customer LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) ON conv_id = c_custkey
"""

QUERIES = {
    "kept_messages": (kept_messages, KEPT_SQL),
    "appended_messages": (appended_messages, APPENDED_SQL),
    "saved_turns": (saved_turns, SAVED_SQL),
    "refused_turns": (refused_turns, REFUSED_SQL),
    "history_windows": (history_windows, HISTORY_SQL),
    "message_lists": (message_lists, MESSAGE_LISTS_SQL),
    "conversation_titles": (conversation_titles, TITLES_SQL),
    "pruned_conversations": (pruned_conversations, PRUNED_SQL),
    "owner_conversations": (owner_conversations, OWNER_SQL),
    "one_owner_conversations": (one_owner_conversations, ONE_OWNER_SQL),
    "sidebar_lists": (sidebar_lists, SIDEBAR_SQL),
    "conversation_details": (conversation_details, DETAILS_SQL),
    "refreshed_titles": (refreshed_titles, REFRESHED_SQL),
}
