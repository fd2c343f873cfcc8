"""Command line: export one conversation of a store, or list all of them."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conversations, extract, store
from .operators.detect import DETECTORS, detect
from .plans import export
from .schema import Scope
from .sources.sqlite import open_store
from .sources.vcard import contacts, no_contacts


def file_digits(number: str) -> str:
    digits = re.sub(r"\D", "", number)
    return digits[1:] if len(digits) == 11 and digits.startswith("1") else digits


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="parlance")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export", help="write one conversation as text and JSON lines")
    e.add_argument("database")
    e.add_argument("--chat-id", type=int, default=1)
    e.add_argument("--number", required=True)
    e.add_argument("--target-handles", required=True, help="handle numbers of the other side, by commas")
    e.add_argument("--out-dir", default=".")
    e.add_argument("--sample", type=int)
    e.add_argument("--contacts", help="vCard file or folder")
    e.add_argument("--union", action="store_true", help="all 1:1 chats of the handles")
    e.add_argument("--redact-detected", action="store_true")
    e.add_argument("--anonymize", action="store_true")
    c = sub.add_parser("conversations", help="list conversations, newest first")
    c.add_argument("database")
    c.add_argument("--contacts")
    c.add_argument("--stitch", choices=("exact", "fuzzy"), default="exact")
    return p.parse_args(argv if argv and argv[0] in ("export", "conversations", "-h", "--help") else ["export", *argv])


def _one(spark: SparkSession, number: str, chats: list[int], handles: list[int]) -> DataFrame:
    """The conversation that the options name; it is never a group."""
    row = (number, number, chats, handles, [number], 0.0, 0, number, False, False, [], None)
    return spark.createDataFrame([row], conversations.CONVERSATION)


def labels(spark: SparkSession, tables: dict[str, DataFrame], vcards: str | None) -> tuple[DataFrame, DataFrame]:
    """Labels of all handles, a name where the contacts have one, and the contacts."""
    known = contacts(spark, vcards) if vcards else no_contacts(spark)
    return conversations.resolved_labels(store.handle_labels(tables), known), known


def export_command(spark: SparkSession, a: argparse.Namespace) -> None:
    tables = open_store(spark, a.database)
    n = store.counts(tables).first()
    print(f"[db] {n['messages']:,} messages · {n['handles']:,} handles · {n['chats']:,} chats")
    handles = [int(h) for h in a.target_handles.split(",") if h.strip()]
    chats = [a.chat_id]
    if a.union:
        wanted = spark.createDataFrame([(h,) for h in handles], "handle_id long")
        found = store.one_to_one_chats(tables, wanted).collect()  # the chats of one person
        if not found:
            print(f"[union] no 1:1 chats found for handles {sorted(handles)}")
            return
        chats = sorted({r["chat_id"] for r in found})
    named, known = labels(spark, tables, a.contacts)
    conversation = _one(spark, a.number, chats, handles)
    if a.sample is not None:
        raw = extract.extract(tables, conversation, store.handle_labels(tables))
        rows = raw.orderBy("date_ns", "message_rowid").limit(a.sample).collect()
        for r in rows:
            print(f"{r['date']} {r['speaker']}: {r['text']}")
        print(f"[sample] showed {len(rows)} of {raw.count():,} messages")
        return
    if a.contacts:
        c = named.agg(F.count_if("matched").alias("m"), F.count("*").alias("n")).first()
        print(f"[contacts] {known.count():,} handles in contacts · matched {c['m']}/{c['n']} handles")
    if a.union:
        _report(spark, tables, conversation, chats, handles)
    records = extract.extract(tables, conversation, named.select("handle_id", "label")).persist()
    scope = Scope(anonymize_speakers=a.anonymize)
    found = detect(records, DETECTORS)
    redactions = found.drop("category") if a.redact_detected else None
    out = export.export(records, conversations.render_info(conversation), scope, redactions)
    base = Path(a.out_dir) / f"{'union' if a.union else 'messages'}_{file_digits(a.number)}"
    base.parent.mkdir(parents=True, exist_ok=True)
    _write(out.transcript.lines.orderBy("seq").select("text"), base.with_suffix(".txt"), "")
    _write(out.json_lines.orderBy("date_ns", "message_rowid").select("json"), base.with_suffix(".jsonl"), "\n")
    shown = out.transcript.marks.filter("kind = 'highlight'").count()
    print(f"[{'union' if a.union else 'direct'}] {records.count():,} msgs · {found.count():,} secrets flagged ({shown:,} still visible) -> {base}.txt/.jsonl")


def _write(rows: DataFrame, to: Path, end: str) -> None:
    """One conversation, written line by line as it comes."""
    with to.open("w", encoding="utf-8") as f:
        for r in rows.toLocalIterator():
            f.write(r[0] + end)


def _report(spark: SparkSession, tables: dict[str, DataFrame], conversation: DataFrame, chats: list[int], handles: list[int]) -> None:
    own = store.handle_labels(tables)
    records = extract.extract(tables, conversation, own)
    links = extract.bridge(conversation).join(tables["chat_message_join"].withColumnRenamed("message_id", "message_rowid"), "chat_id").distinct()
    per_chat = links.join(records.select("conversation_id", "message_rowid"), ["conversation_id", "message_rowid"]).groupBy("conversation_id", "chat_id").agg(F.count("*").alias("messages"))
    print(f"[union] handles {sorted(handles)} → {len(chats)} one-to-one chat(s):")
    for r in per_chat.orderBy("chat_id").collect():
        print(f"        chat {r['chat_id']}  {r['messages']:,} msgs")
    for r in extract.union_report(records, per_chat).collect():
        print(f"[union] {r['messages']:,} distinct of {r['sum_per_chat']:,} in all chats, {r['duplicates']:,} seen twice")
        print(f"[union] chat {r['largest_chat']} alone would lack {r['recovered']:,}")
    print("[union] by service: " + " · ".join(f"{r['service']} {r['messages']:,}" for r in extract.by_service(records).collect()))
    for r in records.filter("coalesce(service, 'iMessage') <> 'iMessage'").orderBy("date_ns", "message_rowid").limit(3).collect():
        print(f"        {r['date']} {r['speaker']} [{r['service']}]: {r['text'][:64]}")


def conversations_command(spark: SparkSession, a: argparse.Namespace) -> None:
    tables = open_store(spark, a.database)
    known = contacts(spark, a.contacts) if a.contacts else no_contacts(spark)
    found = conversations.list_conversations(
        store.summaries(tables), store.group_summaries(tables), store.handle_labels(tables), store.participant_counts(tables), known, a.stitch
    )
    rows = found.collect()  # what is printed
    if not rows:
        print("[conversations] no conversations found")
        return
    print(f"[conversations] {len(rows):,} (newest first):")
    for r in rows:
        print(f"  {r['display_name']}  ·  {r['message_count']:,} msgs  ·  chat-id {','.join(map(str, r['chat_ids']))}  ·  target-handles {','.join(map(str, r['target_handles']))}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("parlance").getOrCreate()
    (export_command if a.command == "export" else conversations_command)(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
