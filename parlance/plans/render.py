"""Transcripts: the lines of all conversations with their marks, one text per conversation, and JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.body import format_reactions, strip_placeholders
from ..functions.spans import (
    INDENT,
    REDACTED,
    body_replacements,
    output_to_source,
    segments,
    source_to_output,
    splice,
)
from ..functions.text import comma, json_string, utf16_length
from ..operators.redact import aliases_by_conversation, anonymization_map, covers, with_redactions
from ..schema import REACTIONS, TrimOptions

#: The lines of the preamble.
REACTIONS_LEGEND = "# Reactions shown as [%s: ❤️] after the message they target."
ATTACHMENTS_LEGEND = "# Attachments shown as typed placeholders: [photo] [video] [gif] [audio] [pdf] [contact] [shared location]."
TIMES_NOTE = "# Times are local, 24h. Section headers are calendar days."


@dataclass
class Rendered:
    """``lines``: ``(conversation_id, seq, text)``, each text with its line break; ``marks``: ``(conversation_id, kind,
    start, end, guid, src_start, src_end, category)`` with UTF-16 offsets into the transcript, kinds ``redacted``,
    ``highlight`` and ``body``; ``bodies``: ``(conversation_id, guid, start, end, segments)``, what selections need."""

    lines: DataFrame
    marks: DataFrame
    bodies: DataFrame

    def text(self) -> DataFrame:
        """``(conversation_id, text)``; one row, and one task's memory, per conversation. ``lines`` has no such limit."""
        packed = F.sort_array(F.collect_list(F.struct("seq", "text")))
        return self.lines.groupBy("conversation_id").agg(F.array_join(F.transform(packed, lambda x: x["text"]), "").alias("text"))


def _day(date: Column, form: str) -> Column:
    return F.date_format(F.timestamp_seconds(date), form)


def bodies(records: DataFrame, redactions: DataFrame | None, names: DataFrame | None, trim: TrimOptions) -> DataFrame:
    """``records`` with ``source`` (the text after trims), ``tombstone``, ``reps`` (what is spliced in) and the aliases.

    A message is a tombstone if it is redacted as a whole, or a span covers its text as it was before any trim.
    """
    df = with_redactions(records, redactions)
    df = df.withColumn("tombstone", F.col("guid").isNotNull() & (F.col("whole") | covers(F.col("spans"), utf16_length(F.col("text")))))
    df = df.withColumn("spans", F.when(F.col("guid").isNotNull(), F.col("spans")).otherwise(F.slice("spans", 1, 0)))
    source = F.col("text")
    if trim.drop_attachment_placeholders:
        source = F.when(F.col("had_attachment"), strip_placeholders(source)).otherwise(source)
    df = df.withColumn("source", source)
    if trim.drop_attachment_placeholders:
        df = df.filter(~(F.col("had_attachment") & (F.col("source") == "")))
    if trim.drop_reactions:
        df = df.withColumn("reactions", F.array().cast(REACTIONS))
    if names is None:
        return df.withColumn("reps", body_replacements(F.col("source"), F.col("spans"))).withColumn("aliases", F.lit(None).cast("map<string,string>"))
    df = df.join(names.select("conversation_id", "aliases", "names"), "conversation_id", "left")
    return df.withColumn("reps", body_replacements(F.col("source"), F.col("spans"), F.col("names"))).drop("names")


def _alias(label: Column) -> Column:
    return F.coalesce(F.element_at("aliases", label), label)


def _aliased_reactions() -> Column:
    return F.transform("reactions", lambda r: F.struct(_alias(r["by"]).alias("by"), r["emoji"].alias("emoji")))


def transcript(
    records: DataFrame, info: DataFrame, *, redactions: DataFrame | None = None, detected: DataFrame | None = None, events: DataFrame | None = None,
    anonymize: bool = False, trim: TrimOptions = TrimOptions(),
) -> Rendered:
    """The transcripts of all conversations of ``records``, by the days and times of the session's time zone.

    ``info`` has ``(conversation_id, number, group_name, participant_labels)``, see ``conversations.render_info``.
    ``events`` show in group transcripts that aren't anonymized. An event comes before a message of the same second,
    and behind a run of removed messages that it falls into.
    """
    mapping = aliases_by_conversation(anonymization_map(records)) if anonymize else None
    rows = bodies(records, redactions, mapping, trim)
    info = info.withColumn("as_group", F.col("group_name").isNotNull() & F.lit(not anonymize))
    rows = rows.join(info.select("conversation_id", "as_group"), "conversation_id", "left")
    kinds = rows.select(
        "conversation_id", "date", F.lit(1).alias("kind"), "date_ns", F.col("message_rowid").alias("id"), "guid", "speaker", "source", "reps", "reactions",
        "aliases", "tombstone", F.lit(None).cast("string").alias("line"),
    )
    if events is not None and not anonymize:
        shown = events.join(info.filter("as_group").select("conversation_id"), "conversation_id", "left_semi").join(records.select("conversation_id").distinct(), "conversation_id", "left_semi")
        kinds = kinds.unionByName(
            shown.select("conversation_id", "date", F.lit(0).alias("kind"), "date_ns", F.col("message_rowid").alias("id"), "line", F.lit(False).alias("tombstone")), allowMissingColumns=True
        )
    order = Window.partitionBy("conversation_id").orderBy("date", "kind", "date_ns", "id")
    messages = Window.partitionBy("conversation_id", "is_message").orderBy("date", "kind", "date_ns", "id")
    kinds = kinds.withColumn("day", _day(F.col("date"), "yyyy-MM-dd")).withColumn("is_message", F.col("kind") == 1)
    # A run of tombstones among the messages of one day; events don't break it.
    breaks = F.col("is_message") & ~(F.col("tombstone") & F.coalesce(F.lag("tombstone").over(messages), F.lit(False)) & F.coalesce(F.lag("day").over(messages) == F.col("day"), F.lit(False)))
    kinds = kinds.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(messages))
    runs = Window.partitionBy("conversation_id", "is_message", "run")
    kinds = kinds.withColumn("run_length", F.count("*").over(runs)).filter("NOT tombstone OR breaks OR NOT is_message")
    # An event within a run stands behind it already: only the run's first message is left, and it is earlier.
    time = _day(F.col("date"), "HH:mm")
    prefix = F.concat(time, F.lit(" "), _alias(F.col("speaker")) if anonymize else F.col("speaker"), F.lit(": "))
    indented = F.replace(splice(F.col("source"), F.col("reps")), F.lit("\n"), F.lit("\n" + " " * INDENT))
    reactions = _aliased_reactions() if anonymize else F.col("reactions")
    header = F.concat(F.lit("\n## "), F.col("day"), F.lit(" ("), _day(F.col("date"), "EEE"), F.lit(")\n"))
    kinds = kinds.withColumn("header", F.when(F.coalesce(F.lag("day").over(order) == F.col("day"), F.lit(False)), "").otherwise(header))
    token = F.when(F.col("run_length") >= 2, F.concat(F.lit("["), F.col("run_length").cast("string"), F.lit(" messages removed]"))).otherwise("[redacted message]")
    kinds = kinds.withColumn("prefix", F.when(F.col("tombstone") | ~F.col("is_message"), "").otherwise(prefix)).withColumn(
        "body", F.when(~F.col("is_message"), F.concat(time, F.lit(" — "), F.col("line"))).when(F.col("tombstone"), token).otherwise(indented)
    )
    kinds = kinds.withColumn("tail", F.when(F.col("tombstone") | ~F.col("is_message"), "\n").otherwise(F.concat(format_reactions(reactions), F.lit("\n"))))
    kinds = kinds.withColumn("seq", F.row_number().over(order))
    head = _preamble(rows, info, mapping, anonymize, trim)
    text = F.concat("header", "prefix", "body", "tail")
    size = kinds.join(head.select("conversation_id", utf16_length(F.col("text")).alias("head")), "conversation_id")
    at = F.col("head") + F.coalesce(F.sum(utf16_length(text)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = size.withColumn("at", at + utf16_length(F.col("header")) + utf16_length(F.col("prefix"))).withColumn("segments", segments(F.col("source"), F.col("reps")))
    lines = kinds.select("conversation_id", "seq", text.alias("text")).unionByName(head.select("conversation_id", F.lit(0).alias("seq"), "text"))
    return Rendered(lines, _marks(placed, detected), placed.filter("is_message AND NOT tombstone AND guid IS NOT NULL").select(
        "conversation_id", "guid", F.col("at").cast("int").alias("start"), (F.col("at") + utf16_length(F.col("body"))).cast("int").alias("end"), "segments"
    ))


def _preamble(rows: DataFrame, info: DataFrame, mapping: DataFrame | None, anonymize: bool, trim: TrimOptions) -> DataFrame:
    """``(conversation_id, text)``; counts are of the messages after trims, removed ones included."""
    sums = rows.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.sum(F.size("reactions")).alias("r"), F.count_if("had_attachment").alias("a"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    ).join(info, "conversation_id", "left")
    number = F.coalesce("number", "conversation_id")
    if mapping is not None:
        sums = sums.join(mapping.select("conversation_id", "people"), "conversation_id", "left")
    counted = [F.concat(comma(F.col("n")), F.lit(" messages"))]
    if not trim.drop_reactions:
        counted.append(F.concat(comma(F.col("r")), F.lit(" reactions")))
    if not trim.drop_attachment_placeholders:
        counted.append(F.concat(comma(F.col("a")), F.lit(" with attachments")))
    one = F.lit("# iMessage transcript") if anonymize else F.concat(F.lit("# iMessage transcript with "), number)
    title = F.when(F.col("as_group"), F.concat(F.lit('# iMessage group transcript: "'), F.col("group_name"), F.lit('"'))).otherwise(one)
    span = F.concat(F.lit("# "), _day(F.col("first"), "yyyy-MM-dd"), F.lit(" → "), _day(F.col("last"), "yyyy-MM-dd"), F.lit(" · "), F.concat_ws(" · ", *counted))
    if anonymize:
        people = F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("people", F.lit(1)), F.lit(1)).cast("int")), lambda k: F.format_string("Person %d (P%d)", k, k))
        who = F.concat(F.lit("# Speakers: "), F.array_join(people, ", "), F.lit(" — names anonymized."))
    else:
        who = F.concat(F.lit("# Speakers: Me = the account owner, Them = "), number)
    who = F.when(F.col("as_group"), F.concat(F.lit("# Participants: "), F.array_join(F.concat(F.array(F.lit("Me = the account owner")), F.col("participant_labels")), " · "))).otherwise(who)
    lines = [title, span, who]
    if not trim.drop_reactions:
        reactor = F.when(F.col("as_group"), F.coalesce(F.get("participant_labels", F.lit(0)), F.lit("a member"))).otherwise("PN" if anonymize else "Them")
        lines.append(F.format_string(REACTIONS_LEGEND, reactor))
    if not trim.drop_attachment_placeholders:
        lines.append(F.lit(ATTACHMENTS_LEGEND))
    return sums.select("conversation_id", F.concat(F.concat_ws("\n", *lines, F.lit(TIMES_NOTE)), F.lit("\n\n")).alias("text"))


def _marks(placed: DataFrame, detected: DataFrame | None) -> DataFrame:
    """Where redactions and secrets that still show are in the transcript."""
    none = F.lit(None)
    shown = placed.filter("is_message AND guid IS NOT NULL")
    tombs = shown.filter("tombstone").select(
        "conversation_id", F.lit("redacted").alias("kind"), F.col("at").cast("int").alias("start"), (F.col("at") + F.length("body")).cast("int").alias("end"), "guid",
        none.cast("int").alias("src_start"), none.cast("int").alias("src_end"), none.cast("string").alias("category"),
    )
    live = shown.filter("NOT tombstone")
    spans = live.select("conversation_id", "guid", "at", "segments", F.explode(F.filter("reps", lambda r: r["redaction"])).alias("r"))
    start = F.col("at") + source_to_output(F.col("segments"), F.col("r.start"))
    spliced = spans.select(
        "conversation_id", F.lit("redacted").alias("kind"), start.cast("int").alias("start"), (start + len(REDACTED)).cast("int").alias("end"), "guid",
        F.col("r.start").alias("src_start"), F.col("r.end").alias("src_end"), none.cast("string").alias("category"),
    )
    out = tombs.unionByName(spliced)
    if detected is not None:
        d = detected.select("conversation_id", "guid", F.col("start").alias("lo"), F.col("end").alias("hi"), "category")
        open_ = ~F.exists("reps", lambda r: r["redaction"] & (r["start"] <= F.col("lo")) & (r["end"] >= F.col("hi")))
        hits = live.join(d, ["conversation_id", "guid"]).filter(open_ & (F.col("lo") >= 0) & (F.col("hi") <= utf16_length(F.col("source"))))
        a, b = (F.col("at") + source_to_output(F.col("segments"), F.col(c)) for c in ("lo", "hi"))
        out = out.unionByName(
            hits.select("conversation_id", F.lit("highlight").alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("end"), "guid", F.col("lo").alias("src_start"), F.col("hi").alias("src_end"), "category").filter("end > start")
        )
    return out


def selected(bodies_: DataFrame, selections: DataFrame) -> DataFrame:
    """Redactions for ``selections (conversation_id, start, end)`` of transcripts: whole bodies, or parts of them."""
    s = selections.filter("end > start").select("conversation_id", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = bodies_.join(s, "conversation_id").withColumn("lo", F.greatest("s", "start")).withColumn("hi", F.least("e", "end")).filter("lo < hi")
    all_of_it = (F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("end"))
    a, b = (output_to_source(F.col("segments"), F.col(c) - F.col("start")) for c in ("lo", "hi"))
    part = hit.withColumn("is_whole", all_of_it).withColumn("a", F.when(~all_of_it, a)).withColumn("b", F.when(~all_of_it, b))
    return part.filter("is_whole OR a < b").select("conversation_id", "guid", F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"))


def rendered_bodies(records: DataFrame, redactions: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """``records`` with their texts as they are shown; messages that are redacted as a whole go. No trims."""
    df = bodies(records, redactions, mapping, TrimOptions()).filter("NOT tombstone")
    return df.withColumn("text", splice(F.col("source"), F.col("reps")))


def redacted_texts(records: DataFrame, redactions: DataFrame | None = None) -> DataFrame:
    """``records`` with their redacted texts. Only a message redacted as a whole goes; where spans cover all of a text the
    mark of what was redacted stays, unlike in ``rendered_bodies``."""
    df = with_redactions(records, redactions).filter("guid IS NULL OR NOT whole")
    cut = F.when(F.col("guid").isNotNull(), F.col("spans")).otherwise(F.slice("spans", 1, 0))
    return df.withColumn("text", splice(F.col("text"), body_replacements(F.col("text"), cut))).select(*records.columns)


def json_lines(records: DataFrame, redactions: DataFrame | None = None, anonymize: bool = False) -> DataFrame:
    """``(conversation_id, date_ns, message_rowid, json)``, one object per message: when, who, what, and where it differs
    the service and the reactions. Trims don't hold here. Order by date_ns and rowid within a conversation."""
    mapping = aliases_by_conversation(anonymization_map(records)) if anonymize else None
    df = rendered_bodies(records, redactions, mapping)
    alias = _alias if anonymize else lambda c: c
    pair = lambda k, v: F.concat(F.lit(f'"{k}": '), v)
    reacts = F.array_join(F.transform("reactions", lambda r: F.concat(F.lit('{"by": '), json_string(alias(r["by"])), F.lit(', "r": '), json_string(r["emoji"]), F.lit("}"))), ", ")
    fields = F.concat_ws(
        ", ", pair("d", json_string(_day(F.col("date"), "yyyy-MM-dd HH:mm:ss"))), pair("s", json_string(alias(F.col("speaker")))), pair("m", json_string(F.col("text"))),
        F.when(F.col("service").isNotNull() & (F.col("service") != "iMessage"), pair("svc", json_string(F.col("service")))),
        F.when(F.size("reactions") > 0, F.concat(F.lit('"reacts": ['), reacts, F.lit("]"))),
    )
    return df.select("conversation_id", "date_ns", "message_rowid", F.concat(F.lit("{"), fields, F.lit("}")).alias("json"))
