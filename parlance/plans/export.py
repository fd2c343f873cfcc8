"""Exports: what of a conversation is shown, from records or straight from a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.body import strip_placeholders
from ..operators.conversations import render_info
from ..operators.detect import Registry, detect, scrub
from ..operators.extract import extract, system_events
from ..operators.lineage import cut
from ..operators.redact import added, aliases_by_conversation, anonymization_map
from ..schema import REACTIONS, Scope
from . import render as r


def in_range(df: DataFrame, scope: Scope) -> DataFrame:
    return df if scope.date_range is None else df.filter(F.col("date").between(*scope.date_range))


def prepared_records(records: DataFrame, scope: Scope) -> DataFrame:
    """Records in range, trimmed, with aliases for labels; texts keep names. Aliases are those of the range, untrimmed."""
    own = in_range(records, scope)
    df = own
    if scope.trim.drop_attachment_placeholders:
        df = df.withColumn("text", F.when(F.col("had_attachment"), strip_placeholders(F.col("text"))).otherwise(F.col("text")))
        df = df.filter(~(F.col("had_attachment") & (F.col("text") == "")))
    if scope.trim.drop_reactions:
        df = df.withColumn("reactions", F.array().cast(REACTIONS))
    if scope.anonymize_speakers:
        df = df.join(aliases_by_conversation(anonymization_map(own)).select("conversation_id", "aliases"), "conversation_id", "left")
        df = df.withColumn("speaker", F.coalesce(F.element_at("aliases", F.col("speaker")), "speaker"))
        df = df.withColumn("reactions", F.transform("reactions", lambda x: F.struct(F.coalesce(F.element_at("aliases", x["by"]), x["by"]).alias("by"), x["emoji"].alias("emoji")))).drop("aliases")
    return df.select(*records.columns)


def effective_redactions(manual: DataFrame | None, records: DataFrame, scope: Scope, registry: Registry | None = None) -> DataFrame | None:
    """The redactions given and the spans that enabled scrubbers find."""
    if not scope.enabled_scrubbers:
        return manual
    found = scrub(records, scope.enabled_scrubbers, registry)
    return found if manual is None else added(manual, found)


def prepared_redacted_records(records: DataFrame, scope: Scope, redactions: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Prepared records with redactions and, if anonymized, names in texts spliced; whole redacted messages go."""
    own = in_range(records, scope)
    mapping = aliases_by_conversation(anonymization_map(own)) if scope.anonymize_speakers else None
    effective = effective_redactions(redactions, own, scope, registry)
    return r.rendered_bodies(prepared_records(own, scope), effective, mapping).select(*records.columns)


@dataclass
class Exported:
    transcript: r.Rendered
    json_lines: DataFrame
    detected: DataFrame
    records: DataFrame


def export(
    records: DataFrame, info: DataFrame, scope: Scope = Scope(), redactions: DataFrame | None = None, events: DataFrame | None = None, registry: Registry | None = None
) -> Exported:
    """Filter, detect on what is left, redact, render. Conversations without messages in range have no rows at all.

    The records in range are written once, into the shared folder, as every output reads them."""
    own = cut(in_range(records, scope), "records")
    found = detect(own, scope.enabled_detectors, registry)
    effective = effective_redactions(redactions, own, scope, registry)
    shown = in_range(events, scope) if events is not None and scope.show_system_events else None
    text = r.transcript(own, info, redactions=effective, detected=found, events=shown, anonymize=scope.anonymize_speakers, trim=scope.trim)
    return Exported(text, r.json_lines(own, effective, scope.anonymize_speakers), found, own)


def export_store(store: dict[str, DataFrame], conversations: DataFrame, labels: DataFrame, scope: Scope = Scope(), redactions: DataFrame | None = None, registry: Registry | None = None) -> Exported:
    """All ``conversations`` of a store at once. ``labels (handle_id, label)``: names where known, else raw handles."""
    events = system_events(store, conversations, labels) if scope.show_system_events else None
    return export(extract(store, conversations, labels), render_info(conversations), scope, redactions, events, registry)


def write(exported: Exported, to: str) -> None:
    """``to/txt`` and ``to/jsonl``, one folder for each conversation, its lines in order.

    Rows are dealt by conversation and sorted; a conversation is written by one task, which streams its lines.
    """
    lines = exported.transcript.lines.withColumn("value", F.regexp_replace("text", r"\n\z", ""))
    lines.repartition("conversation_id").sortWithinPartitions("conversation_id", "seq").select("conversation_id", "value").write.partitionBy("conversation_id").mode("overwrite").text(f"{to}/txt")
    json = exported.json_lines.withColumnRenamed("json", "value")
    json.repartition("conversation_id").sortWithinPartitions("conversation_id", "date_ns", "message_rowid").select("conversation_id", "value").write.partitionBy("conversation_id").mode("overwrite").text(f"{to}/jsonl")
