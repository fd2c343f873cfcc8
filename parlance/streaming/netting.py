"""Streams of a store: reactions netted as they come, and volumes by day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import body
from ..operators.store import seconds
from ..sources.sqlite import register

NETTED = "conversation_id string, target_guid string, reactor string, by string, emoji string, is_remove boolean"


class LastEvent(StatefulProcessor):
    """Keeps the last event of each (conversation, message, reactor) and gives it out whenever it changes.

    An event that comes late, with an earlier date than the one kept, changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "date long, seq long, by string, emoji string, is_remove boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.last.get() if self.last.exists() else None
        best = tuple(kept) if kept is not None else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                event = (int(r.date), int(r.seq), r.by, r.emoji, bool(r.is_remove))
                if best is None or event[:2] >= best[:2]:
                    best = event
        if best is not None and (kept is None or tuple(kept) != best):
            self.last.update(best)
            yield pd.DataFrame([(*key, *best[2:])], columns=["conversation_id", "target_guid", "reactor", "by", "emoji", "is_remove"])

    def close(self) -> None:
        pass


def net_stream(events: DataFrame) -> DataFrame:
    """The changes of netted reactions in a stream of events, columns as in ``operators.reactions.net``.

    Needs the RocksDB state store. A consumer keeps the last row of each key and drops those with ``is_remove``.
    """
    return events.groupBy("conversation_id", "target_guid", "reactor").transformWithStateInPandas(LastEvent(), NETTED, "Update", "none")


def net_stream_aggregated(events: DataFrame) -> DataFrame:
    """The same state by a streaming aggregate, for update or complete output."""
    last = F.max_by(F.struct("is_remove", "by", "emoji"), F.struct("date", "seq")).alias("last")
    return events.groupBy("conversation_id", "target_guid", "reactor").agg(last).select("conversation_id", "target_guid", "reactor", "last.by", "last.emoji", "last.is_remove")


def message_stream(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """New rows of ``message`` by ROWID. Rows that change later are not seen again: reconcile with a batch at times."""
    register(spark)
    return spark.readStream.format("message_store").option("path", path).option("table", "message").option("start", start).load()


def reaction_events(messages: DataFrame, conversation_id: str = "all") -> DataFrame:
    """Reaction events of a stream of messages, all in one conversation."""
    kind = F.coalesce("associated_message_type", F.lit(0))
    known = kind.between(2000, 2006) | kind.between(3000, 3006)
    mine = F.coalesce(F.col("is_from_me") != 0, F.lit(False))
    who = F.when(mine, "me").otherwise(F.concat(F.lit("h"), F.coalesce("handle_id", F.lit(0)).cast("string")))
    return messages.filter(known & F.col("associated_message_guid").isNotNull()).select(
        F.lit(conversation_id).alias("conversation_id"), body.target_guid(F.col("associated_message_guid")).alias("target_guid"), who.alias("reactor"),
        F.when(mine, "Me").otherwise(who).alias("by"), F.when(kind % 1000 == 6, F.coalesce("associated_message_emoji", F.lit("•"))).otherwise(body.tapback(kind, F.lit(None).cast("string"))).alias("emoji"),
        (kind >= 3000).alias("is_remove"), F.coalesce("date", F.lit(0)).alias("date"), F.col("ROWID").alias("seq"),
    )


def daily_volume(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages by calendar day; a day is final once a message is ``late`` behind it."""
    stamped = messages.withColumn("at", F.timestamp_seconds(seconds(F.col("date"))))
    return stamped.withWatermark("at", late).groupBy(F.window("at", "1 day")).agg(F.count("*").alias("messages")).select(F.col("window.start").alias("day"), "messages")
