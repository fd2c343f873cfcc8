"""Sets of redactions, and names behind aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import ME, aliasable
from ..functions.spans import SPAN, no_spans

KEY = ["conversation_id", "guid"]


def absorbed(redactions: DataFrame) -> DataFrame:
    """Each redaction once; the spans of a message that is redacted as a whole go."""
    whole = redactions.filter("start IS NULL").select(*KEY).distinct()
    spans = redactions.filter("start IS NOT NULL").distinct().join(whole, KEY, "left_anti")
    none = F.lit(None).cast("int")
    return spans.select(*KEY, "start", "end").unionByName(whole.select(*KEY, none.alias("start"), none.alias("end")))


def added(redactions: DataFrame, more: DataFrame) -> DataFrame:
    return absorbed(redactions.select(*KEY, "start", "end").unionByName(more.select(*KEY, "start", "end")))


def removed(redactions: DataFrame, gone: DataFrame) -> DataFrame:
    same = [redactions[c].eqNullSafe(gone[c]) for c in (*KEY, "start", "end")]
    return redactions.join(gone, same, "left_anti")


def contains(redactions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` that are in the set, a span also where its whole message is."""
    own = absorbed(redactions)
    hit = own["conversation_id"].eqNullSafe(wanted["conversation_id"]) & own["guid"].eqNullSafe(wanted["guid"]) & (
        own["start"].isNull() | (own["start"].eqNullSafe(wanted["start"]) & own["end"].eqNullSafe(wanted["end"]))
    )
    return wanted.join(own, hit, "left_semi")


def with_redactions(records: DataFrame, redactions: DataFrame | None) -> DataFrame:
    """``records`` with ``whole`` and ``spans``, the redactions of each message."""
    if redactions is None:
        return records.withColumn("whole", F.lit(False)).withColumn("spans", no_spans())
    packed = redactions.groupBy(*KEY).agg(
        F.max(F.col("start").isNull()).alias("whole"),
        F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("spans"),
    )
    out = records.join(packed, KEY, "left")
    return out.withColumn("whole", F.coalesce("whole", F.lit(False))).withColumn("spans", F.coalesce(F.col("spans").cast(f"array<{SPAN}>"), no_spans()))


def covers(spans: Column, length: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] == 0) & (s["end"] == length))


def anonymization_map(records: DataFrame) -> DataFrame:
    """``(conversation_id, label, alias)``: P1, P2, ... by first appearance, the owner of the account always first.

    A speaker appears before the authors of the reactions to the message. First appearances are aggregated before the
    window, which then has one row per label.
    """
    at = F.struct("date_ns", "message_rowid")
    speakers = records.select("conversation_id", F.col("speaker").alias("label"), at.alias("at"), F.lit(-1).alias("place"))
    authors = records.select("conversation_id", at.alias("at"), F.posexplode("reactions").alias("place", "r")).select("conversation_id", F.col("r.by").alias("label"), "at", "place")
    first = speakers.unionByName(authors).groupBy("conversation_id", "label").agg(F.min(F.struct("at", "place")).alias("first"))
    order = Window.partitionBy("conversation_id").orderBy(F.col("label") != ME, "first", "label")
    return first.select("conversation_id", "label", F.concat(F.lit("P"), F.row_number().over(order).cast("string")).alias("alias"))


def aliases_by_conversation(mapping: DataFrame) -> DataFrame:
    """``(conversation_id, aliases, names)``: all labels as a map, and those that are names, the longest first."""
    pair = F.struct(F.col("label"), F.col("alias"))
    names = F.sort_array(F.collect_list(F.when(aliasable(F.col("label")), F.struct((-F.length("label")).alias("k"), F.col("label"), F.col("alias")))))
    return mapping.groupBy("conversation_id").agg(
        F.map_from_entries(F.collect_list(pair)).alias("aliases"), F.count("*").alias("people"),
        F.transform(names, lambda x: F.struct(x["label"].alias("label"), x["alias"].alias("alias"))).alias("names"),
    )
