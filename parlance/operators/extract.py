"""Extraction of the ordered messages and system events of all conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import body
from ..functions.identity import speaker_label, system_event_label
from ..schema import OPTIONAL, REACTIONS, has_columns
from ..sources.typedstream import decode_body
from .lineage import cut
from .reactions import by_message, net
from .store import seconds

#: Kinds of reactions; the second range takes one of the first back.
ADDED, REMOVED = (2000, 2006), (3000, 3006)


def bridge(conversations: DataFrame) -> DataFrame:
    """``(conversation_id, chat_id)``, from ``conversations (id, chat_ids)``."""
    return conversations.select(F.col("id").alias("conversation_id"), F.explode("chat_ids").alias("chat_id"))


def kept(conversations: DataFrame) -> DataFrame:
    """What extraction needs of ``conversations``, as a table: it is read for every join, and has a row per conversation only."""
    if hasattr(conversations, "cut_path"):
        return conversations
    return cut(conversations.select("id", "chat_ids", "target_handles", "is_group", "participants"), "conversations")


def label_dimension(conversations: DataFrame, global_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that hold in one conversation, and those that hold in all.

    The first is ``(conversation_id, handle_id, own_label, is_target, on_roster)``: the handles of the other side of a
    1:1 conversation, and the members of a group that have a label. The second is ``(handle_id, label)``.
    """
    one = conversations.filter(~F.col("is_group")).select(
        F.col("id").alias("conversation_id"), F.explode("target_handles").alias("handle_id"), F.lit(None).cast("string").alias("own_label"),
        F.lit(True).alias("is_target"), F.lit(False).alias("on_roster"),
    )
    many = (
        conversations.filter("is_group").select(F.col("id").alias("conversation_id"), F.explode("participants").alias("p"))
        .filter("p.label IS NOT NULL")
        .select("conversation_id", F.col("p.handle_id").alias("handle_id"), F.col("p.label").alias("own_label"), F.lit(False).alias("is_target"), F.lit(True).alias("on_roster"))
    )
    own = one.unionByName(many).groupBy("conversation_id", "handle_id").agg(
        F.first("own_label").alias("own_label"), F.max("is_target").alias("is_target"), F.max("on_roster").alias("on_roster")
    )
    return own, global_labels.select("handle_id", "label")


def _in_conversations(store: dict[str, DataFrame], chats: DataFrame) -> DataFrame:
    """Messages with each conversation they are in, once, however many of its chats have them."""
    links = store["chat_message_join"].join(chats, "chat_id").select("conversation_id", F.col("message_id").alias("message_rowid")).distinct()
    return links.join(store["message"].withColumnRenamed("ROWID", "message_rowid"), "message_rowid")


def _labelled(df: DataFrame, labels: tuple[DataFrame, DataFrame], handle: str = "handle_id", prefix: str = "") -> DataFrame:
    own, every = labels
    own = own.select("conversation_id", F.col("handle_id").alias(handle), *[F.col(c).alias(prefix + c) for c in ("own_label", "is_target", "on_roster")])
    every = every.select(F.col("handle_id").alias(handle), F.col("label").alias(f"{prefix}label"))
    out = df.join(own, ["conversation_id", handle], "left").join(every, handle, "left")
    return out.withColumns({
        f"{prefix}label": F.coalesce(f"{prefix}own_label", f"{prefix}label"),
        f"{prefix}is_target": F.coalesce(f"{prefix}is_target", F.lit(False)),
        f"{prefix}on_roster": F.coalesce(f"{prefix}on_roster", F.lit(False)),
    })


def attachments(store: dict[str, DataFrame]) -> DataFrame:
    """``(message_rowid, placeholders)`` in the order of the links; a link that is met twice counts once."""
    a = store["attachment"].select(F.col("ROWID").alias("attachment_id"), body.placeholder(F.col("mime_type"), F.col("uti"), F.col("transfer_name")).alias("p"))
    links = store["message_attachment_join"].select(F.col("ROWID").alias("link"), "message_id", "attachment_id").dropDuplicates(["link"])
    ordered = F.sort_array(F.collect_list(F.struct("link", "p")))  # in a struct, so that no null is lost
    return links.join(a, "attachment_id").groupBy(F.col("message_id").alias("message_rowid")).agg(F.transform(ordered, lambda x: x["p"]).alias("placeholders"))


def extract(store: dict[str, DataFrame], conversations: DataFrame, global_labels: DataFrame) -> DataFrame:
    """Records (``schema.RECORDS``) of all ``conversations``.

    A message in several chats of a conversation counts once. Reactions never become messages; what is left loses
    system events, retracted messages and those without text. A reaction goes to the last message that has its guid,
    in the order of (date, rowid); those that find none are dropped. Their guids are compared among the messages left.
    """
    conversations = kept(conversations)
    labels = label_dimension(conversations, global_labels)
    rows = _labelled(
        _in_conversations(store, bridge(conversations)).withColumns({
            "date": F.coalesce("date", F.lit(0)), "handle_id": F.coalesce("handle_id", F.lit(0)),
            "is_from_me": F.coalesce(F.col("is_from_me") != 0, F.lit(False)), "kind": F.coalesce("associated_message_type", F.lit(0)),
        }),
        labels,
    ).withColumn("speaker", speaker_label(F.col("is_from_me"), F.col("is_target"), F.col("label"), F.col("handle_id")))
    is_reaction = (F.col("kind").between(*ADDED) | F.col("kind").between(*REMOVED)) & F.col("associated_message_guid").isNotNull()
    kinds = F.col("kind").between(*ADDED) | F.col("kind").between(*REMOVED)
    events = rows.filter(is_reaction).select(
        "conversation_id", body.target_guid(F.col("associated_message_guid")).alias("target_guid"),
        F.when(F.col("is_from_me"), "me").otherwise(F.concat(F.lit("h"), F.col("handle_id").cast("string"))).alias("reactor"),
        F.col("speaker").alias("by"),
        F.when(F.col("kind") % 1000 == 6, F.coalesce("associated_message_emoji", F.lit("•"))).otherwise(body.tapback(F.col("kind"), F.lit(None).cast("string"))).alias("emoji"),
        F.col("kind").between(*REMOVED).alias("is_remove"), "date", F.col("message_rowid").alias("seq"),
    )
    written = rows.filter(~kinds & (F.coalesce("item_type", F.lit(0)) == 0) & (F.coalesce("date_retracted", F.lit(0)) == 0))
    # Only rich bodies pass through Python, each once; where there are none the join goes away.
    rich = store["message"].filter("attributedBody IS NOT NULL").select(F.col("ROWID").alias("message_rowid"), decode_body(F.col("attributedBody")).alias("decoded"))
    text, had = body.render_text(F.col("raw"), F.col("placeholders"), F.col("balloon_bundle_id"))
    messages = (
        written.drop("attributedBody").join(attachments(store), "message_rowid", "left").join(rich, "message_rowid", "left").withColumn("raw", F.coalesce("decoded", "text"))
        .select(
            "conversation_id", "message_rowid", F.col("date").alias("date_ns"), "guid", F.floor(seconds(F.col("date"))).cast("long").alias("date"), "speaker",
            (~F.col("is_from_me") & F.col("is_target")).alias("is_target"), "service", text.alias("text"), had.alias("had_attachment"),
        )
        .filter("text <> ''")
    )
    # Messages without a guid are no group of equals. The join finds the rows as the window left them, dealt and sorted.
    last = Window.partitionBy("conversation_id", "_key").orderBy(F.desc("date_ns"), F.desc("message_rowid"))
    messages = messages.withColumn("_key", F.coalesce("guid", F.concat(F.lit("\0"), F.col("message_rowid").cast("string")))).withColumn("_k", F.row_number().over(last))
    reactions = by_message(net(events)).select(F.col("conversation_id").alias("_of"), "target_guid", "reactions")
    met = (F.col("conversation_id") == F.col("_of")) & (F.col("_key") == F.col("target_guid")) & F.col("guid").isNotNull() & (F.col("_k") == 1)
    out = messages.join(reactions, met, "left").drop("_key", "_k", "_of", "target_guid")
    none = F.array().cast(REACTIONS)
    return out.withColumn("had_attachment", F.coalesce("had_attachment", F.lit(False))).withColumn("reactions", F.coalesce("reactions", none))


def system_events(store: dict[str, DataFrame], conversations: DataFrame, global_labels: DataFrame) -> DataFrame:
    """``(conversation_id, message_rowid, date_ns, date, line)``: who added, removed, renamed or left. Older stores have none."""
    if not has_columns(store["message"], OPTIONAL):
        return conversations.sparkSession.createDataFrame([], "conversation_id string, message_rowid long, date_ns long, date long, line string")
    conversations = kept(conversations)
    labels = label_dimension(conversations, global_labels)
    rows = _in_conversations(store, bridge(conversations)).filter(F.col("item_type").isin(1, 2, 3)).withColumns({
        "handle_id": F.coalesce("handle_id", F.lit(0)), "other_handle": F.coalesce("other_handle", F.lit(0)),
        "is_from_me": F.coalesce(F.col("is_from_me") != 0, F.lit(False)),
    })
    rows = _labelled(_labelled(rows, labels), labels, "other_handle", "o_")
    actor = system_event_label(F.col("is_from_me"), F.col("label"), F.col("on_roster"), F.col("handle_id"))
    other = system_event_label(F.lit(False), F.col("o_label"), F.col("o_on_roster"), F.col("other_handle"))
    line = (
        F.when(F.col("item_type") == 1, body.add_remove_line(actor, other, F.coalesce("group_action_type", F.lit(0)) == 0))
        .when(F.col("item_type") == 2, body.rename_line(actor, F.col("group_title")))
        .otherwise(body.left_line(actor))
    )
    date = F.floor(seconds(F.coalesce("date", F.lit(0)))).cast("long")
    return rows.select("conversation_id", "message_rowid", F.coalesce("date", F.lit(0)).alias("date_ns"), date.alias("date"), line.alias("line")).filter("line IS NOT NULL")


def stats(records: DataFrame) -> DataFrame:
    """Messages, reactions and messages with attachments of each conversation."""
    return records.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.sum(F.size("reactions")).alias("reactions"), F.count_if("had_attachment").alias("with_attachments")
    )


def union_report(records: DataFrame, per_chat: DataFrame) -> DataFrame:
    """What joining chats of one person did: ``per_chat (conversation_id, chat_id, messages)`` against the union."""
    sums = per_chat.groupBy("conversation_id").agg(
        F.sum("messages").alias("sum_per_chat"), F.max_by("chat_id", F.struct("messages", -F.col("chat_id"))).alias("largest_chat"), F.max("messages").alias("largest")
    )
    return records.groupBy("conversation_id").agg(F.count("*").alias("messages")).join(sums, "conversation_id").select(
        "conversation_id", "messages", "sum_per_chat", (F.col("sum_per_chat") - F.col("messages")).alias("duplicates"),
        "largest_chat", (F.col("messages") - F.col("largest")).alias("recovered"),
    )


def by_service(records: DataFrame) -> DataFrame:
    return records.groupBy("conversation_id", F.coalesce("service", F.lit("—")).alias("service")).agg(F.count("*").alias("messages")).orderBy("conversation_id", F.desc("messages"), "service")
