"""Queries over the tables of a store: counts, bounds, rosters and the summaries of chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STORE_EPOCH

ONE_TO_ONE, GROUP = 45, 43


def is_real(m: DataFrame) -> Column:
    """A message somebody wrote: neither a system event nor a reaction."""
    return (F.coalesce(m["item_type"], F.lit(0)) == 0) & (F.coalesce(m["associated_message_type"], F.lit(0)) == 0)


def seconds(date: Column) -> Column:
    """Seconds since 1970 of a date of the store, as a double with its fraction."""
    return date.cast("double") / 1e9 + STORE_EPOCH


def counts(store: dict[str, DataFrame]) -> DataFrame:
    one = lambda t, name: store[t].agg(F.count("*").alias(name))  # noqa: E731 - one row each
    return one("message", "messages").join(one("handle", "handles")).join(one("chat", "chats"))


def date_bounds(messages: DataFrame) -> DataFrame:
    """``(first, last)`` in nanoseconds of the store; 0 stands for no date, and no dates at all give nulls."""
    return messages.filter("date > 0").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def watermark(messages: DataFrame) -> DataFrame:
    return messages.agg(F.coalesce(F.max("ROWID"), F.lit(0)).alias("watermark"))


def handle_labels(store: dict[str, DataFrame]) -> DataFrame:
    return store["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("label"))


def one_to_one_chats(store: dict[str, DataFrame], handles: DataFrame) -> DataFrame:
    """``(chat_id, identifier, service, handle_id)`` of the 1:1 chats with any of ``handles (handle_id)``."""
    chat = store["chat"].filter(F.col("style") == ONE_TO_ONE)
    return (
        store["chat_handle_join"].join(handles, "handle_id", "left_semi")
        .join(chat, F.col("chat_id") == F.col("ROWID"))
        .select("chat_id", F.col("chat_identifier").alias("identifier"), F.col("service_name").alias("service"), "handle_id")
        .orderBy("chat_id", "handle_id")
    )


def _linked_messages(store: dict[str, DataFrame], style: int) -> DataFrame:
    chat = store["chat"].filter(F.col("style") == style).select(F.col("ROWID").alias("chat_id"))
    m = store["message"]
    m = m.filter(is_real(m)).select(F.col("ROWID").alias("message_id"), "date", "is_from_me", "handle_id")
    return store["chat_message_join"].join(chat, "chat_id", "left_semi").join(m, "message_id")


def summaries(store: dict[str, DataFrame]) -> DataFrame:
    """One row per 1:1 chat: identifier, service, a handle, date of the newest message, number of messages.

    Messages are counted once for each handle a chat has; the handle shown is the largest, as is its date's tie.
    Messages are aggregated by chat before handles are joined, so none is copied.
    """
    chat = store["chat"].filter(F.col("style") == ONE_TO_ONE)
    per_chat = _linked_messages(store, ONE_TO_ONE).groupBy("chat_id").agg(F.max(F.coalesce("date", F.lit(0))).alias("last"), F.count("*").alias("n"))
    per_handle = store["chat_handle_join"].groupBy("chat_id").agg(F.max("handle_id").alias("handle_id"), F.count("*").alias("k"))
    return (
        per_chat.join(per_handle, "chat_id").join(chat.withColumnRenamed("ROWID", "chat_id"), "chat_id")
        .select(
            "chat_id", F.col("chat_identifier").alias("identifier"), F.col("service_name").alias("service"), "handle_id",
            seconds(F.col("last")).alias("last_message_date"), (F.col("n") * F.col("k")).alias("message_count"),
        )
        .orderBy(F.desc("last_message_date"), "chat_id")
    )


def rosters(store: dict[str, DataFrame]) -> DataFrame:
    """``(chat_id, participant_handles)``: the sorted handles of each group chat that has any."""
    chat = store["chat"].filter(F.col("style") == GROUP).select(F.col("ROWID").alias("chat_id"))
    return store["chat_handle_join"].join(chat, "chat_id", "left_semi").groupBy("chat_id").agg(F.sort_array(F.collect_list("handle_id")).alias("participant_handles"))


def group_summaries(store: dict[str, DataFrame]) -> DataFrame:
    """One row per group chat: identifier, service, name, sorted handles, newest date, number of messages."""
    chat = store["chat"].filter(F.col("style") == GROUP).withColumnRenamed("ROWID", "chat_id")
    per_chat = _linked_messages(store, GROUP).groupBy("chat_id").agg(F.max(F.coalesce("date", F.lit(0))).alias("last"), F.count("*").alias("n"))
    return (
        per_chat.join(chat, "chat_id").join(rosters(store), "chat_id", "left")
        .select(
            "chat_id", F.col("chat_identifier").alias("identifier"), F.col("service_name").alias("service"), "display_name",
            F.coalesce("participant_handles", F.array().cast("array<bigint>")).alias("participant_handles"),
            seconds(F.col("last")).alias("last_message_date"), F.col("n").alias("message_count"),
        )
        .orderBy(F.desc("last_message_date"), "chat_id")
    )


def participant_counts(store: dict[str, DataFrame]) -> DataFrame:
    """``(chat_id, handle_id, message_count)`` of what others wrote in group chats."""
    return _linked_messages(store, GROUP).filter("is_from_me = 0").groupBy("chat_id", "handle_id").agg(F.count("*").alias("message_count"))
