"""Netting of reactions: for each message and reactor the last event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.body import display_rank


def net(events: DataFrame) -> DataFrame:
    """``(conversation_id, target_guid, reactor, by, emoji)``: reactions that were not removed again.

    ``events`` has ``conversation_id, target_guid, reactor, by, emoji, is_remove, date, seq``. Adding sets the state of
    a reactor and removing clears it, so the state is that of the last event by (date, seq), one aggregate that
    combines before its shuffle.
    """
    last = F.max_by(F.struct("is_remove", "by", "emoji"), F.struct("date", "seq")).alias("last")
    return (
        events.groupBy("conversation_id", "target_guid", "reactor").agg(last)
        .filter(~F.col("last.is_remove"))
        .select("conversation_id", "target_guid", "reactor", "last.by", "last.emoji")
    )


def by_message(netted: DataFrame) -> DataFrame:
    """``(conversation_id, target_guid, reactions)`` in display order: Them, Me, others by label, then emoji."""
    ordered = F.sort_array(F.collect_list(F.struct(display_rank(F.col("by")).alias("rank"), "by", "emoji")))
    shown = F.transform(ordered, lambda r: F.struct(r["by"].alias("by"), r["emoji"].alias("emoji")))
    return netted.groupBy("conversation_id", "target_guid").agg(shown.alias("reactions"))
