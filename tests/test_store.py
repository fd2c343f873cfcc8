from __future__ import annotations

import sqlite3

import pytest
from fixtures import AUTUMN, CHOIR, HARBOUR, SPRING, make, ns
from pyspark.sql import functions as F

from parlance import cli
from parlance.operators import conversations, extract, store
from parlance.schema import SchemaProblem, UnsupportedSchemaError, schema_problems
from parlance.sources import sqlite, typedstream, vcard


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    return sqlite.open_store(spark, make(tmp_path_factory.mktemp("h") / "chat.db", HARBOUR))


@pytest.fixture(scope="module")
def choir(spark, tmp_path_factory):
    return sqlite.open_store(spark, make(tmp_path_factory.mktemp("c") / "chat.db", CHOIR, events=True), ranges=2)


def contacts(spark, rows=()):
    return spark.createDataFrame(list(rows), "handle string, name string")


def singers(spark):
    return contacts(spark, [("+33144550011", "Odile Brun"), ("+33144550012", "Yann Morel"), ("+33144550013", "Odile Petit")])


def test_counts_and_bounds(harbour, choir, spark):
    assert tuple(store.counts(harbour).first()) == (6, 3, 4)
    assert tuple(store.date_bounds(choir["message"]).first()) == (ns(AUTUMN), ns(AUTUMN + 80))
    assert store.watermark(choir["message"]).first()[0] == 213
    none = spark.createDataFrame([], harbour["message"].schema)
    assert tuple(store.date_bounds(none).first()) == (None, None) and store.watermark(none).first()[0] == 0


def test_chats_of_a_person(harbour, spark):
    handles = lambda *h: spark.createDataFrame([(x,) for x in h], "handle_id long")
    assert [r["chat_id"] for r in store.one_to_one_chats(harbour, handles(11, 12)).collect()] == [4, 9]
    assert [r["chat_id"] for r in store.one_to_one_chats(harbour, handles(15)).collect()] == [6]
    assert store.one_to_one_chats(harbour, handles()).isEmpty()


def test_summaries_are_newest_first(harbour):
    got = [(r["chat_id"], r["message_count"]) for r in store.summaries(harbour).collect()]
    assert got == [(6, 1), (4, 2), (9, 2)]  # the reaction is no message
    assert [(r["chat_id"], r["participant_handles"]) for r in store.group_summaries(harbour).collect()] == [(2, [11, 15])]


def test_one_person_over_two_services(harbour, spark):
    labels = store.handle_labels(harbour)
    people = {r["id"]: r for r in conversations.people(store.summaries(harbour), contacts(spark), labels).collect()}
    p = people["+442079460018"]
    assert set(people) == {"+442079460018", "nora@quay.example"}
    assert (p["chat_ids"], p["target_handles"], p["is_contact"]) == ([4, 9], [11, 12], False)
    everyone = conversations.people(store.summaries(harbour), contacts(spark), labels)
    rows = extract.extract(harbour, everyone.filter("id = '+442079460018'"), labels).orderBy("date_ns", "message_rowid").collect()
    assert [(r["guid"], r["speaker"], r["service"]) for r in rows] == [("h-21", "Them", "iMessage"), ("h-23", "Them", "SMS"), ("h-22", "Me", "iMessage")]
    assert rows[2]["text"] == "Until Friday [pdf] see map" and rows[2]["had_attachment"] and rows[2]["date"] == 978307200 + SPRING + 60
    assert [(x["by"], x["emoji"]) for x in rows[2]["reactions"]] == [("Them", "👍")] and not rows[0]["reactions"]
    assert extract.extract(harbour, everyone.limit(0), labels).isEmpty()


def test_rows_that_are_no_messages(spark, tmp_path):
    """Null flags count as 0; unsent and blank messages go; an unknown kind of association is a message."""
    from fixtures import sql_rows

    more = sql_rows("handle", "ROWID, id", [(8, "q")]) + sql_rows("chat", "ROWID, style", [(3, 45)]) + sql_rows("chat_handle_join", "chat_id, handle_id", [(3, 8)])
    more += sql_rows("message", "ROWID, guid, date, is_from_me, handle_id, text, date_retracted, item_type, associated_message_type", [
        (70, "plain", ns(9), None, None, "no flags at all", None, None, None), (71, "unsent", ns(10), 0, 8, "never mind", ns(11), 0, 0),
        (72, "sticker", ns(12), 0, 8, "a kind of its own", 0, 0, 1000), (73, "blank", ns(13), 0, 8, " \t ", 0, 0, 0), (74, "system", ns(14), 0, 8, "moved", 0, 4, 0),
    ])
    more += sql_rows("chat_message_join", "chat_id, message_id", [(3, k) for k in range(70, 75)])
    s = sqlite.open_store(spark, make(tmp_path / "r.db", more))
    people = conversations.people(store.summaries(s), contacts(spark), store.handle_labels(s))
    rows = extract.extract(s, people, store.handle_labels(s)).orderBy("message_rowid").collect()
    assert [(r["guid"], r["speaker"]) for r in rows] == [("plain", "h0"), ("sticker", "Them")]


def test_a_group_over_two_chats(choir, spark):
    labels = store.handle_labels(choir)
    args = store.group_summaries(choir), labels, store.participant_counts(choir)
    bare = {r["id"]: r for r in conversations.groups(*args).collect()}
    assert {k: r["chat_ids"] for k, r in bare.items()} == {"group:31,32,33": [50, 51], "group:31,34": [52]}
    g = bare["group:31,32,33"]
    assert (g["message_count"], g["display_name"], [p["handle_id"] for p in g["participants"]]) == (4, "Choir", [32, 33, 31])  # by volume
    named = conversations.groups(*args, singers(spark)).filter("id = 'group:31,32,33'")
    assert [(p["handle_id"], p["label"]) for p in named.first()["participants"]] == [(32, "Yann"), (33, "Odile P."), (31, "Odile B.")]
    rows = extract.extract(choir, named, labels).orderBy("date_ns").collect()
    assert [(r["speaker"], r["service"]) for r in rows] == [("Yann", "iMessage"), ("Odile P.", "iMessage"), ("Me", "iMessage"), ("Yann", "SMS")]
    assert [(x["by"], x["emoji"]) for x in rows[0]["reactions"]] == [("Odile B.", "‼️")]  # the other one was taken back


def test_events_of_a_group(choir, spark):
    labels = store.handle_labels(choir)
    args = store.group_summaries(choir), labels, store.participant_counts(choir)
    lines = lambda groups: [x["line"] for x in extract.system_events(choir, groups.filter("id = 'group:31,32,33'"), labels).orderBy("date_ns").collect()]
    assert lines(conversations.groups(*args, singers(spark))) == ['Odile B. named the group "Tuesday choir"', "Yann added lea@choir.example", "Odile P. left", "Me removed lea@choir.example"]
    assert lines(conversations.groups(*args))[0] == '+33144550011 named the group "Tuesday choir"'


def test_no_events_in_old_stores(harbour, spark):
    people = conversations.people(store.summaries(harbour), contacts(spark), store.handle_labels(harbour))
    assert extract.system_events(harbour, people, store.handle_labels(harbour)).isEmpty()


def test_listing(choir, spark):
    args = [store.summaries(choir), store.group_summaries(choir), store.handle_labels(choir), store.participant_counts(choir)]
    ids = [r["id"] for r in conversations.list_conversations(*args, contacts(spark)).collect()]
    assert ids == ["lea@choir.example", "group:31,34", "group:31,32,33"]
    with pytest.raises(ValueError, match="stitch"):
        conversations.list_conversations(*args, contacts(spark), stitch="loose")


@pytest.mark.parametrize(("people", "want"), [(["Alice Tan", "Bob Vance"], ["Alice", "Bob"]), (["Mike Rivera", "Mike Sanders", "Dana Cole"], ["Mike R.", "Mike S.", "Dana"]), (["Mike Rivera", "Mike Reyes"], ["Mike Rivera", "Mike Reyes"]), (["Mike", "Mike Reyes"], ["Mike", "Mike R."])])
def test_speaker_labels(spark, people, want):
    roster = spark.createDataFrame([("g", k, f"i{k}") for k in range(len(people))], "id string, handle_id long, identifier string")
    known = contacts(spark, [(f"i{k}", n) for k, n in enumerate(people)])
    assert [r["label"] for r in conversations.speaker_labels(roster, known).orderBy("handle_id").collect()] == want


def _groups(spark, rosters, named=()):
    rows = [(f"g{k}", f"g{k}", [k], list(r), [], float(100 - k), 1, f"p{k}", False, True, [(h, f"i{h}", None) for h in r], dict(named).get(k)) for k, r in enumerate(rosters)]
    return spark.createDataFrame(rows, conversations.CONVERSATION)


@pytest.mark.parametrize(
    ("rosters", "named", "want"),
    [
        ([(3, 5, 7), (3, 5, 7, 9)], (), 1), ([tuple(range(8)), tuple(range(12))], (), 2), ([tuple(range(1, 10)), (*range(1, 9), 10)], (), 2),
        ([tuple(range(1, 10)), (*range(1, 9), 10)], ((0, "x"), (1, "x")), 1), ([range(1, 5), range(1, 6), range(1, 8)], (), 2), ([range(1, 5), range(1, 6), range(1, 7)], (), 1), ([(1, 2), (1, 2, 3)], (), 2),
    ],
)
def test_fuzzy(spark, rosters, named, want):
    merged = conversations.fuzzy_merge(_groups(spark, rosters, named))
    assert merged.count() == want
    if want == 1:
        r = merged.first()
        assert r["message_count"] == len(rosters) and r["target_handles"] == sorted(set().union(*rosters)) and len(r["participants"]) == len(r["target_handles"])


def test_fuzzy_pairs_against_all_pairs(spark):
    import itertools
    import random

    r = random.Random(2)
    rosters = [tuple(sorted(r.sample(range(12), r.randint(2, 9)))) for _ in range(60)]
    rosters = list(dict.fromkeys(rosters))
    got = {(x["a"], x["b"]) for x in conversations.fuzzy_pairs(_groups(spark, rosters, {k: "n" for k in range(0, 60, 2)}.items())).collect()}

    def match(i, j):
        a, b = set(rosters[i]), set(rosters[j])
        if min(len(a), len(b)) < 3:
            return False
        if (a <= b or b <= a) and abs(len(a) - len(b)) <= 3 and min(len(a), len(b)) / max(len(a), len(b)) >= 0.6:
            return True
        return len(a & b) / len(a | b) >= 0.8 and i % 2 == 0 and j % 2 == 0

    want = {tuple(sorted((f"g{i}", f"g{j}"))) for i, j in itertools.combinations(range(len(rosters)), 2) if match(i, j)}
    assert got == want and want


def test_guard(spark, tmp_path):
    assert schema_problems({}) [0] == SchemaProblem("handle")
    path = make(tmp_path / "x.db", "ALTER TABLE message DROP COLUMN attributedBody; DROP TABLE attachment;")
    with pytest.raises(UnsupportedSchemaError, match=r"message.attributedBody, attachment \(missing table\)"):
        sqlite.open_store(spark, path)


def test_live_reads(spark, tmp_path):
    """What a writer has committed is seen, before and after it closes; a snapshot keeps it."""
    path = make(tmp_path / "live.db", CHOIR, events=True)
    writer = sqlite3.connect(path)
    writer.execute("PRAGMA journal_mode=WAL")
    before = sqlite.open_store(spark, path)["message"].count()
    writer.execute("INSERT INTO message (ROWID, guid, date, text) VALUES (400, 'late', ?, 'encore')", (ns(AUTUMN + 500),))
    assert sqlite.watermark(path) == 213
    writer.commit()
    assert sqlite.watermark(path) == 400 and sqlite.open_store(spark, path)["message"].count() == before + 1 == 14
    copy = sqlite.snapshot(spark, path, str(tmp_path / "copy"))
    assert copy["message"].count() == 14 and copy["attachment"].count() == 0
    few = spark.read.format("message_store").option("path", path).option("table", "message").option("where", f"date >= {ns(AUTUMN + 70)}")
    assert few.load().count() == 3
    writer.close()


def test_retry():
    tries = []

    def read():
        tries.append(1)
        if len(tries) < 3:
            raise sqlite3.OperationalError("database is locked")
        return 7

    assert sqlite.with_retry(read, backoff=0) == 7
    with pytest.raises(sqlite3.OperationalError):
        sqlite.with_retry(lambda: (_ for _ in ()).throw(sqlite3.OperationalError("no such table")), backoff=0)


def test_typedstream():
    def blob(s):
        data = s.encode()
        size = bytes([len(data)]) if len(data) < 0x80 else b"\x81" + len(data).to_bytes(2, "little")
        return b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSAttributedString\x00\x84\x84\x08NSObject\x00\x85\x92\x84\x84\x84\x08NSString\x01\x94\x84\x01+" + size + data + b"\x86"

    assert typedstream.decode(blob("héllo")) == "héllo"
    assert typedstream.decode(blob("x" * 300)) == "x" * 300
    assert typedstream.decode(b"junk") is None and typedstream.decode(None) is None and typedstream.decode(blob("abc")[:-3]) is None


def test_vcard(spark, tmp_path):
    (tmp_path / "c.vcf").write_text(
        "BEGIN:VCARD\r\nVERSION:3.0\r\nN:Thompson;Maya;;;\r\nTEL;TYPE=CELL:+1 (415) 555-0142\r\nitem1.EMAIL:Maya@Example.com\r\nPHOTO;ENCODING=b:aGVs\r\n bG8=\r\nEND:VCARD\r\n"
        "BEGIN:VCARD\r\nN:;Mom;;;\r\nTEL:4155550142\r\nTEL:503 555 0146\r\nEND:VCARD\r\nBEGIN:VCARD\r\nORG:Acme\\, Inc;Sales\r\nTEL:8165550100\r\nEND:VCARD\r\nBEGIN:VCARD\r\nTEL:8165550199\r\nEND:VCARD\r\n"
    )
    got = {r["handle"]: (r["name"], r["photo"]) for r in vcard.contacts(spark, str(tmp_path / "c.vcf")).collect()}
    assert got == {"+14155550142": ("Maya Thompson", b"hello"), "maya@example.com": ("Maya Thompson", b"hello"), "+15035550146": ("Mom", None), "+18165550100": ("Acme, Inc", None)}


def test_command_line(spark, tmp_path, capsys):
    path = make(tmp_path / "chat.db", HARBOUR)
    cli.main([path, "--chat-id", "4", "--number", "+44 20 7946 0018", "--target-handles", "11,12", "--union", "--out-dir", str(tmp_path / "out")], spark)
    said = capsys.readouterr().out
    assert "3 distinct of 4 in all chats, 1 seen twice" in said and "iMessage 2 · SMS 1" in said
    (txt,), (jsonl,) = (list((tmp_path / "out").glob(f"union_*.{kind}")) for kind in ("txt", "jsonl"))
    assert "14:26 Them: Is the mooring free?\n14:27 Them: Texting from the water\n" in txt.read_text() and "Me: Until Friday [pdf] see map  [Them: 👍]" in txt.read_text() and jsonl.read_text().count("\n") == 3
    cli.main(["export", path, "--chat-id", "6", "--number", "1", "--target-handles", "15", "--sample", "5"], spark)
    assert "Them: The invoice is paid" in capsys.readouterr().out
    cli.main(["conversations", path], spark)
    assert "chat-id 4,9" in capsys.readouterr().out
