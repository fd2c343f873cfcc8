from __future__ import annotations

import sqlite3

from fixtures import AUTUMN, CHOIR, make, ns

from parlance.streaming import netting

EVENTS = "conversation_id string, target_guid string, reactor string, by string, emoji string, is_remove boolean, date long, seq long"


def rows(spark, name):
    return spark.sql(f"SELECT * FROM {name}").collect()


def batches(spark, tmp_path, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


PARTS = [
    [("c", "g", "h1", "Ann", "👍", False, 1, 1), ("c", "g", "me", "Me", "❤️", False, 2, 2)],
    [("c", "g", "h1", "Ann", "👍", True, 5, 5), ("c", "g", "me", "Me", "😂", False, 4, 4)],
    [("c", "g", "h1", "Ann", "👎", False, 3, 3)],  # late: the removal is newer
]


def test_netting_in_a_stream(spark, tmp_path):
    stream = netting.net_stream(batches(spark, tmp_path, PARTS))
    q = stream.writeStream.format("memory").queryName("netted").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = {(r["target_guid"], r["reactor"]): (r["emoji"], r["is_remove"]) for r in rows(spark, "netted")}
    assert last == {("g", "h1"): ("👍", True), ("g", "me"): ("😂", False)}
    assert len(rows(spark, "netted")) == 4


def test_netting_by_aggregate(spark, tmp_path):
    stream = netting.net_stream_aggregated(batches(spark, tmp_path, PARTS))
    q = stream.writeStream.format("memory").queryName("netted2").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["reactor"], r["emoji"], r["is_remove"]) for r in rows(spark, "netted2")} == {("h1", "👍", True), ("me", "😂", False)}


def test_new_messages(spark, tmp_path):
    """The stream goes on from the last row it has seen."""
    path = make(tmp_path / "s.db", CHOIR, events=True)
    stream = netting.reaction_events(netting.message_stream(spark, path))
    q = stream.writeStream.format("memory").queryName("events").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    seen = {(r["target_guid"], r["reactor"], r["emoji"], r["is_remove"]) for r in rows(spark, "events")}
    assert seen == {("ch-a", "h33", "😂", False), ("ch-a", "h33", "😂", True), ("ch-a", "h31", "‼️", False)}
    db = sqlite3.connect(path)
    new = "INSERT INTO message (ROWID, guid, date, is_from_me, associated_message_type, associated_message_guid, associated_message_emoji) VALUES (500, 'ch-z', ?, 1, 2006, 'p:0/ch-b', '🎼')"
    db.execute(new, (ns(AUTUMN + 900),))
    db.commit()
    db.close()
    q.processAllAvailable()
    q.stop()
    assert [(r["target_guid"], r["by"], r["emoji"], r["is_remove"]) for r in rows(spark, "events")][3:] == [("ch-b", "Me", "🎼", False)]


def test_daily_volume(spark, tmp_path):
    day = 86_400 * 10**9
    spark.createDataFrame([(k * day // 4,) for k in range(9)], "date long").write.parquet(f"{tmp_path}/in")
    stream = netting.daily_volume(spark.readStream.schema("date long").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("volume").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["messages"] for r in rows(spark, "volume")) == 9
