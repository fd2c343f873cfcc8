"""Message stores made of other tables, so that every operator can run over data at any scale.

They exercise the operators; nothing in them says how real stores look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STORE_EPOCH

BASE = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(name: str, kind: str = "string"):
    return F.lit(None).cast(kind).alias(name)


def conversation_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``conversations`` as 1:1 chats. Chat and handle ``c`` are conversation ``c``; ``c % 40`` makes the number, so people
    have several chats. The assistant is the other side and system turns are system events. Every fifth message gets a
    reaction, every tenth takes it back, every seventh has an attachment, and each ninth conversation's messages are
    also in the next chat of the same number."""
    c = table(spark, sf_dir, "conversations")
    convs = c.select("conv_id").distinct()
    number = F.concat(F.lit("+1555"), F.lpad((F.col("conv_id") % 40).cast("string"), 7, "0"))
    service = F.when(F.col("conv_id") % 3 == 0, "SMS").otherwise("iMessage")
    row = F.col("conv_id") * 1000 + F.col("turn")
    when = (F.lit(BASE - STORE_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60) * F.lit(1_000_000_000).cast("long")
    mine = (F.col("role") == "user").cast("long")
    zero = F.lit(0).cast("long")
    kinds = F.when(row % 10 == 0, F.array(F.lit(0), F.lit(2000), F.lit(3000))).when(row % 5 == 0, F.array(F.lit(0), F.lit(2000))).otherwise(F.array(F.lit(0)))
    every = c.withColumn("kind", F.explode(kinds))  # 0: the message itself
    own, user, later = F.col("kind") == 0, F.col("role") == "user", (F.col("kind") >= 3000).cast("long")
    rowid = F.when(own, row).otherwise(F.lit(10**12) + row * 2 + later)
    messages = every.select(
        rowid.alias("ROWID"), F.when(own, F.concat(F.lit("m"), row.cast("string"))).otherwise(F.concat(F.lit("r"), row.cast("string"), F.lit("-"), F.col("kind").cast("string"))).alias("guid"),
        F.when(own, when).otherwise(when + 1 + later).alias("date"), F.when(own, mine).otherwise(1 - mine).alias("is_from_me"),
        F.when(own == user, zero).otherwise(F.col("conv_id")).alias("handle_id"), service.alias("service"),
        F.when(own, F.when(row % 7 == 0, F.concat("text", F.lit("￼"))).otherwise(F.col("text"))).alias("text"), _null("attributedBody", "binary"),
        F.when(own & (F.col("role") == "system"), 2).otherwise(0).cast("long").alias("item_type"),
        F.when(own, 0).otherwise(F.col("kind") + F.col("turn") % 6).cast("long").alias("associated_message_type"),
        F.when(~own, F.concat(F.lit("p:0/m"), row.cast("string"))).alias("associated_message_guid"), _null("associated_message_emoji"), _null("balloon_bundle_id"),
        zero.alias("date_retracted"), zero.alias("group_action_type"), F.when(own & (F.col("role") == "system"), F.substring("text", 1, 20)).alias("group_title"), zero.alias("other_handle"),
    )
    chats = F.when(F.col("conv_id") % 9 == 0, F.array(F.col("conv_id"), F.col("conv_id") + 40)).otherwise(F.array("conv_id"))
    both = every.select(F.explode(chats).alias("chat_id"), rowid.alias("message_id"))
    tail = c.filter(row % 7 == 0).select(row.alias("m"))
    mime = F.element_at(F.array(*[F.lit(x) for x in ("image/jpeg", "image/gif", "video/mp4", "application/pdf", "audio/mp3")]), (F.col("m") % 5 + 1).cast("int"))
    return {
        "handle": convs.select(F.col("conv_id").alias("ROWID"), number.alias("id")),
        "chat": convs.select(F.col("conv_id").alias("ROWID"), number.alias("chat_identifier"), service.alias("service_name"), F.lit(45).cast("long").alias("style"), _null("display_name")),
        "chat_handle_join": convs.select(F.col("conv_id").alias("chat_id"), F.col("conv_id").alias("handle_id")),
        "chat_message_join": both,
        "message": messages,
        "message_attachment_join": tail.select(F.col("m").alias("ROWID"), F.col("m").alias("message_id"), F.col("m").alias("attachment_id")),
        "attachment": tail.select(F.col("m").alias("ROWID"), mime.alias("mime_type"), _null("uti"), _null("transfer_name")),
    }


def order_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as group chats, their suppliers as members, lines as messages (one for each number); every third is one's own."""
    o, li, s = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    every = li
    li = li.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_shipdate", "l_returnflag")])
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    zero = F.lit(0).cast("long")
    mine = (row % 3 == 0).cast("long")
    return {
        "handle": s.select(F.col("s_suppkey").alias("ROWID"), F.concat(F.lit("+1816"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("id")),
        "chat": o.select(F.col("o_orderkey").alias("ROWID"), F.concat(F.lit("chat"), F.col("o_orderkey").cast("string")).alias("chat_identifier"), F.lit("iMessage").alias("service_name"), F.lit(43).cast("long").alias("style"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("display_name")),
        "chat_handle_join": every.select(F.col("l_orderkey").alias("chat_id"), F.col("l_suppkey").alias("handle_id")).distinct(),
        "chat_message_join": li.select(F.col("l_orderkey").alias("chat_id"), row.alias("message_id")),
        "message": li.select(
            row.alias("ROWID"), F.concat(F.lit("l"), row.cast("string")).alias("guid"),
            ((F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - STORE_EPOCH) * F.lit(1_000_000_000).cast("long")).alias("date"), mine.alias("is_from_me"),
            F.col("l_suppkey").alias("handle_id"), F.lit("iMessage").alias("service"), F.col("l_returnflag").alias("text"), zero.alias("item_type"),
            F.when(F.col("l_returnflag") == "R", 2001).otherwise(0).cast("long").alias("associated_message_type"), zero.alias("date_retracted"),
        ),
    }
