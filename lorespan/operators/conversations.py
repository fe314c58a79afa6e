"""Conversation store: messages ``(conv_id, turn, role, text)`` and meta
``(conv_id, title, updated_at, owner_id, seq)``; ``seq`` is the order of creation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.fixed_values import (
    CONVERSATIONS_KEPT, CONVERSATIONS_LISTED, DEFAULT_TITLE, HISTORY_TURNS,
    MESSAGES_KEPT, SIDEBAR_KEPT,
)
from lorespan.functions.text import blank, strip, summary_of, title_of
from lorespan.operators.ordering import keep_first, number_rows

MESSAGE = "struct<role:string,content:string>"


def _in_order() -> Column:
    """Messages of a group as an ordered array; groups are cut to size before."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))


def recent_messages(messages: DataFrame, keep: int = MESSAGES_KEPT) -> DataFrame:
    """Last ``keep`` messages of each conversation; each task sends at most that
    many of a conversation into the shuffle."""
    return keep_first(messages, ["conv_id"], [F.desc("turn")], keep)


def append_turns(messages: DataFrame, new: DataFrame, keep: int = MESSAGES_KEPT) -> DataFrame:
    accepted = new.where(~blank(F.col("text")))
    return recent_messages(messages.unionByName(accepted), keep)


def history(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """``(conv_id, messages)``: the last ``turns`` question-answer pairs."""
    return recent_messages(messages, 2 * turns).groupBy("conv_id").agg(_in_order().alias("messages"))


def earlier_messages(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages before the one being asked, ``asked(conv_id, turn)``."""
    now = asked.select("conv_id", F.col("turn").alias("_turn"))
    return messages.join(now, "conv_id").where("turn < _turn").drop("_turn")


def titles(messages: DataFrame) -> DataFrame:
    """Server title (latest question) and sidebar title (first question)."""
    asked = messages.where("role = 'user'")
    return asked.groupBy("conv_id").agg(
        title_of(F.max_by("text", "turn")).alias("title"),
        summary_of(F.min_by("text", "turn")).alias("summary"))


def prune(meta: DataFrame, messages: DataFrame, keep: int = CONVERSATIONS_KEPT):
    """The ``keep`` most recently updated conversations (older ones first on a tie)."""
    kept = meta.orderBy(F.desc("updated_at"), F.asc("seq")).limit(keep)
    return kept, messages.join(kept.select("conv_id"), "conv_id", "left_semi")


def save_turns(meta: DataFrame, messages: DataFrame, new: DataFrame, keep: int = MESSAGES_KEPT,
               conversations: int = CONVERSATIONS_KEPT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(meta, messages, refused)`` after ``new(conv_id, turn, owner_id, question, answer, asked_at)``.

    A turn with a blank question or of another's conversation is refused.  A new
    conversation belongs to whoever asks first in it.  Question and answer are added
    as turns ``turn`` and ``turn + 1`` and give the title and the time; a turn without
    an answer only opens its conversation.  The last ``keep`` messages stay, and the
    ``conversations`` updated last.
    """
    asked = new.where(~blank(F.col("question")))
    first = asked.groupBy("conv_id").agg(F.min_by("owner_id", "turn").alias("_first"), F.min_by("asked_at", "turn").alias("_at"))
    owners = first.join(meta.select("conv_id", F.col("owner_id").alias("_set")), "conv_id", "left").select(
        "conv_id", "_at", F.coalesce("_set", "_first").alias("_owner"), F.col("_set").isNull().alias("_fresh"))
    judged = new.join(owners.select("conv_id", "_owner"), "conv_id", "left").withColumn(
        "_ok", ~blank(F.coalesce("question", F.lit(""))) & F.col("owner_id").eqNullSafe(F.col("_owner")))
    answered = judged.where(F.col("_ok") & ~blank(F.coalesce("answer", F.lit(""))))
    said = answered.select("conv_id", F.inline(F.array(
        F.struct(F.col("turn"), F.lit("user").alias("role"), strip(F.col("question")).alias("text")),
        F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), strip(F.col("answer")).alias("text")))))
    last = answered.groupBy("conv_id").agg(
        title_of(F.max_by("question", "turn")).alias("_title"), F.max_by("asked_at", "turn").alias("_last"))
    opened = number_rows(owners.where("_fresh"), "_n", ["_at", "conv_id"]).select(
        "conv_id", F.lit(DEFAULT_TITLE).alias("title"), F.col("_at").alias("updated_at"), F.col("_owner").alias("owner_id"),
        (F.col("_n") + (meta.agg(F.max("seq")).first()[0] or 0)).alias("seq"))
    now = meta.select(opened.columns).unionByName(opened).join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_last", "updated_at").alias("updated_at"), "owner_id", "seq")
    kept, shown = prune(now, append_turns(messages, said.select(messages.columns), keep), conversations)
    return kept, shown, judged.where(~F.col("_ok")).select(new.columns)


def list_for(meta: DataFrame, owner: str | int | None = None, n: int = CONVERSATIONS_LISTED) -> DataFrame:
    """Newest ``n`` conversations of one owner, or of every owner at once."""
    order = [F.desc("updated_at"), F.asc("seq")]
    shown = ["conv_id", F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"), "updated_at"]
    if owner is None:
        return keep_first(meta, ["owner_id"], order, n, "position").select("owner_id", "position", *shown)
    return meta.where(F.col("owner_id") == owner).orderBy(*order).limit(n).select(*shown)


def detail(meta: DataFrame, messages: DataFrame, owner: str | int | None = None,
           keep: int = MESSAGES_KEPT) -> DataFrame:
    """One row per conversation with its kept messages in order."""
    wanted = meta if owner is None else meta.where(F.col("owner_id") == owner)
    # Narrow to the wanted conversations first, so others are not grouped.
    mine = messages.join(wanted.select("conv_id"), "conv_id", "left_semi")
    grouped = recent_messages(mine, keep).groupBy("conv_id").agg(_in_order().alias("messages"))
    empty = F.array().cast(f"array<{MESSAGE}>")
    return (wanted.join(grouped, "conv_id", "left")
            .withColumn("messages", F.coalesce("messages", empty)))


def sidebar(updates: DataFrame, keep: int = SIDEBAR_KEPT) -> DataFrame:
    """Latest state per conversation, newest ``keep`` per owner: ``updates(owner_id,
    conv_id, title, ts)``.  The first step combines in each task before the shuffle."""
    latest = updates.groupBy("owner_id", "conv_id").agg(
        F.max(F.struct("ts", "title")).alias("last"))
    rows = latest.select("owner_id", "conv_id", F.col("last.title").alias("title"),
                         F.col("last.ts").alias("ts"))
    return keep_first(rows, ["owner_id"], [F.desc("ts"), F.desc("conv_id")], keep, "position")


def refresh_titles(local: DataFrame, server: DataFrame) -> DataFrame:
    """Local rows take the server's title where it has one."""
    newer = server.select("conv_id", F.nullif("title", F.lit("")).alias("_title"))
    return (local.join(newer, "conv_id", "left")
            .withColumn("title", F.coalesce("_title", "title")).drop("_title"))
