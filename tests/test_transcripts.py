from __future__ import annotations

import random

import pytest
from fixtures import BASE, MENTIONS, PARCEL, SCORES, info, records, redactions
from pyspark.sql import functions as F

from parlance.operators import detect, reactions, redact
from parlance.plans import export, render
from parlance.schema import Scope, TrimOptions

#: Lines that every transcript with typed attachments has.
LEGEND = "# Attachments shown as typed placeholders: [photo] [video] [gif] [audio] [pdf] [contact] [shared location].\n# Times are local, 24h. Section headers are calendar days.\n\n"
CARD = "4111 1111 1111 1111"


def parcel(card: str = CARD) -> str:
    """The transcript of ``PARCEL``, put together by hand."""
    head = "# iMessage transcript with +442079460018\n# 2023-07-10 → 2023-07-12 · 4 messages · 1 reactions · 1 with attachments\n"
    head += "# Speakers: Me = the account owner, Them = +442079460018\n# Reactions shown as [Them: ❤️] after the message they target.\n" + LEGEND
    days = ["\n## 2023-07-10 (Mon)\n09:40 Them: Did the parcel come?\n09:43 Me: Yes\n        at the back door  [Them: 👍]\n"]
    days += [f"\n## 2023-07-11 (Tue)\n09:45 Them: take card {card} for the duty\n", "\n## 2023-07-12 (Wed)\n10:00 Me: paid [pdf]\n"]
    return head + "".join(days)


def text(made):
    return made.text().first()["text"]


def cut16(s, a, b):
    return s.encode("utf-16-be")[2 * a : 2 * b].decode("utf-16-be")


def test_whole_transcript(spark):
    assert text(render.transcript(records(spark, PARCEL), info(spark))) == parcel()


def test_marks_lie_on_what_they_mark(spark):
    r = records(spark, PARCEL)
    found = detect.detect(r)
    assert [(x["guid"], x["category"], x["start"], x["end"]) for x in found.collect()] == [("k3", "creditCard", 10, 29)]
    seen = render.transcript(r, info(spark), detected=found)
    m = seen.marks.first()
    assert (m["kind"], m["category"], cut16(text(seen), m["start"], m["end"])) == ("highlight", "creditCard", CARD)
    hidden = render.transcript(r, info(spark), redactions=found.drop("category"), detected=found)
    assert text(hidden) == parcel("[redacted]")
    (m,) = hidden.marks.collect()
    assert (m["kind"], cut16(text(hidden), m["start"], m["end"]), m["src_start"]) == ("redacted", "[redacted]", 10)


def test_json_lines(spark):
    import json

    r = records(spark, PARCEL)
    lines = [x["json"] for x in render.json_lines(r, detect.detect(r).drop("category")).orderBy("date_ns").collect()]
    assert [json.loads(x) for x in lines] == [
        {"d": "2023-07-10 09:40:00", "s": "Them", "m": "Did the parcel come?"},
        {"d": "2023-07-10 09:43:00", "s": "Me", "m": "Yes\nat the back door", "reacts": [{"by": "Them", "r": "👍"}]},
        {"d": "2023-07-11 09:45:00", "s": "Them", "m": "take card [redacted] for the duty"},
        {"d": "2023-07-12 10:00:00", "s": "Me", "m": "paid [pdf]"},
    ]
    assert lines[3] == '{"d": "2023-07-12 10:00:00", "s": "Me", "m": "paid [pdf]"}'
    assert json.loads(render.json_lines(r.withColumn("service", F.lit("SMS"))).first()["json"])["svc"] == "SMS"


def test_speakers_behind_aliases(spark):
    got = text(render.transcript(records(spark, PARCEL), info(spark), anonymize=True))
    assert got.startswith("# iMessage transcript\n# 2023-07-10 → 2023-07-12 ·") and "# Speakers: Person 1 (P1), Person 2 (P2) — names anonymized.\n" in got
    assert "09:40 P2: Did the parcel come?" in got and "at the back door  [P2: 👍]" in got and "7946" not in got


def test_names_in_bodies(spark):
    """Whole words only, in any case; ``Me`` is the first alias wherever it first speaks."""
    r = records(spark, MENTIONS)
    scope = Scope(anonymize_speakers=True)
    hidden = [x["text"] for x in export.prepared_redacted_records(r, scope).orderBy("date_ns").collect()]
    assert hidden == ["P3 has the keys", "no, P2 does; ask Pavels brother", "P2 or P3, open up"]
    assert [x["text"] for x in export.prepared_records(r, scope).orderBy("date_ns").collect()] == [x[3] for x in MENTIONS]
    assert text(render.transcript(r, info(spark), anonymize=True)).endswith("09:40 P2: P3 has the keys\n09:42 P3: no, P2 does; ask Pavels brother  [P2: 😂]\n09:44 P1: P2 or P3, open up\n")


def test_events_stand_among_messages(spark):
    group = info(spark, group="Tuesday choir", labels=["Yann", "Odile B.", "lea@choir.example"])
    events = spark.createDataFrame(
        [("c", 91, 0, BASE, "Yann added lea@choir.example"), ("c", 92, 0, BASE + 46 * 60, "lea@choir.example left"), ("c", 93, 0, BASE + 86_400, "Me named the group")],
        "conversation_id string, message_rowid long, date_ns long, date long, line string",
    )
    got = text(render.transcript(records(spark, SCORES), group, events=events))
    assert got.startswith('# iMessage group transcript: "Tuesday choir"\n# 2023-07-10 → 2023-07-11 · 3 messages · 2 reactions · 1 with attachments\n# Participants: Me = the account owner · Yann · Odile B. · lea@choir.example\n')
    day = "\n## 2023-07-10 (Mon)\n09:40 — Yann added lea@choir.example\n09:40 Yann: Rehearsal is on Tuesday  [Me: 👍] [Odile B.: ‼️]\n10:25 Odile B.: bring:\n        - scores\n        - pencils\n10:26 — lea@choir.example left\n"
    assert got.endswith(day + "\n## 2023-07-11 (Tue)\n00:40 Me: see you there [video]\n09:40 — Me named the group\n")
    hidden = text(render.transcript(records(spark, SCORES), group, events=events, anonymize=True))
    assert "—" not in hidden.split("\n## ", 1)[1] and "choir" not in hidden


def test_removed_messages(spark):
    """Neighbours that go are counted in one line, within a day; what is partly covered stays."""
    rows = [("t1", 0, "Them", "abc", [], False), ("t2", 1, "Them", "abc", [], False), ("t3", 2, "Me", "abc", [], False), ("t4", 5, "Me", "stays", [], False), ("t5", 1440, "Them", "abc", [], False), ("t6", 1441, "Me", "part of it", [], False)]
    r = records(spark, rows)
    gone = redactions(spark, [("t1", None, None), ("t2", 0, 3), ("t3", None, None), ("t5", None, None), ("t6", 0, 4)])
    made = render.transcript(r, info(spark), redactions=gone)
    whole = text(made)
    assert whole.endswith("## 2023-07-10 (Mon)\n[3 messages removed]\n09:45 Me: stays\n\n## 2023-07-11 (Tue)\n[redacted message]\n09:41 Me: [redacted] of it\n")
    assert "· 6 messages ·" in whole
    assert sorted(cut16(whole, m["start"], m["end"]) for m in made.marks.collect()) == ["[3 messages removed]", "[redacted message]", "[redacted]"]
    assert [x["json"].split('"m": ')[1] for x in render.json_lines(r, gone).orderBy("date_ns").collect()] == ['"stays"}', '"[redacted] of it"}']


def test_trims(spark):
    rows = [("q1", 0, "Me", "[audio]", [], True), ("q2", 4, "Them", "listen [audio] now", [("Me", "😂")], True), ("q3", 8, "Me", "later", [], False)]
    r, both = records(spark, rows), TrimOptions(True, True)
    assert [x["text"] for x in export.prepared_records(r, Scope(trim=both)).orderBy("date_ns").collect()] == ["listen now", "later"]
    got = text(render.transcript(r, info(spark), trim=both))
    assert got.endswith("09:44 Them: listen now\n09:48 Me: later\n") and "· 2 messages\n" in got
    assert not any(word in got for word in ("Reactions", "Attachments", "reactions", "attachments"))


def test_selections_become_redactions(spark):
    """A selection in the output, as a span of a body, or as the whole message where it covers all of it."""
    made = render.transcript(records(spark, PARCEL), info(spark))
    whole = text(made)
    at = lambda part: len(whole[: whole.index(part)].encode("utf-16-be")) // 2

    def picked(a: int, b: int):
        chosen = spark.createDataFrame([("c", a, b)], "conversation_id string, start int, end int")
        return [(r["guid"], r["start"], r["end"]) for r in render.selected(made.bodies, chosen).orderBy("guid").collect()]

    assert picked(at(CARD), at(CARD) + 4) == [("k3", 10, 14)]
    assert picked(at("Did the") - 2, at("come?") + 5) == [("k1", None, None)]
    assert picked(at("come?"), at("Yes") + 2) == [("k1", 15, 20), ("k2", 0, 2)]
    assert picked(0, 10) == [] and picked(at("Yes"), at("Yes")) == []


def test_export_scope(spark):
    rows = [("x1", 0, "Me", "pwd: otter-4471", [], False), ("x2", 60, "Them", "thanks", [], False), ("x3", 120, "Me", "routing number 021000021", [], False)]
    r = records(spark, rows)
    every = {(x["guid"], x["category"], x["start"], x["end"]) for x in export.export(r, info(spark)).detected.collect()}
    assert every == {("x1", "password", 5, 15), ("x3", "bankAccount", 15, 24)}
    some = export.export(r, info(spark), Scope(date_range=(BASE + 3600, BASE + 7200), enabled_detectors=frozenset({"password"})))
    assert some.detected.isEmpty() and [x["guid"] for x in some.records.orderBy("date_ns").collect()] == ["x2", "x3"] and some.json_lines.count() == 2
    assert export.export(r, info(spark), Scope(date_range=(5, 6))).transcript.lines.isEmpty()
    with pytest.raises(ValueError, match="unknown"):
        Scope(enabled_scrubbers=frozenset({"nose"}))


def test_scrubbers(spark):
    rows = [("z1", 0, "Ingrid", "Pavel, write to desk@quay.example or +44 207 946 0018", [], False), ("z2", 1, "Pavel", "security code: 90125 at 12 Mill Lane", [], False)]
    r = records(spark, rows)
    hidden = export.prepared_redacted_records(r, Scope(anonymize_speakers=True, enabled_scrubbers=frozenset({"email", "otp", "postalAddress"}))).orderBy("date_ns")
    assert [x["text"] for x in hidden.collect()] == ["P2, write to [redacted] or +44 207 946 0018", "security code: [redacted] at [redacted]"]
    assert [x["text"] for x in export.prepared_redacted_records(r, Scope()).orderBy("date_ns").collect()] == [x[3] for x in rows]


def test_write(spark, tmp_path):
    export.write(export.export(records(spark, PARCEL), info(spark)), str(tmp_path / "o"))
    lines = [x["value"] for x in spark.read.text(f"{tmp_path}/o/txt/conversation_id=c").collect()]
    assert "\n".join(lines) + "\n" == parcel()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("line one\nssn 123-45-6789 here", [("ssn", "123-45-6789")]), ("secret abc card 4111 1111 1111 1111", [("creditCard", "4111 1111 1111 1111")]), ("card 4111 1111 1111 1112", []),
        ("password is topsecret", [("password", "topsecret")]), ("ssn 000-12-3456", []), ("key sk_live_abcdefghijklmnop1234", [("apiKey", "sk_live_abcdefghijklmnop1234")]),
        ("the door code is 4821 ok", [("standingCode", "4821")]), ("IBAN GB82 WEST 1234 5698 7654 32", [("bankAccount", "GB82 WEST 1234 5698 7654 32")]), ("IBAN GB83 WEST 1234 5698 7654 32", []),
        ("routing number 021000021", [("bankAccount", "021000021")]), ("about 021000021", []), ("call me at 816 555 0100, jane@example.com", []), ("-----BEGIN RSA PRIVATE KEY-----", [("apiKey", "-----BEGIN RSA PRIVATE KEY-----")]),
    ],
)
def test_detectors(spark, body, want):
    r = records(spark, [("g", 0, "Me", body, [], False), (None, 1, "Me", body, [], False)])
    got = [(x["category"], cut16(body, x["start"], x["end"])) for x in detect.detect(r).collect()]
    assert got == want


def test_seed_phrases(spark):
    import hashlib

    words = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiouyaeiouyaeio"[:16] for c in "lmnprstvwxzbcdfg"]
    words = sorted({f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}x" for k in range(2048)})
    entropy = bytes(range(16))
    bits = "".join(f"{b:08b}" for b in entropy) + f"{hashlib.sha256(entropy).digest()[0]:08b}"[:4]
    phrase = " ".join(words[int(bits[k : k + 11], 2)] for k in range(0, 132, 11))
    r = records(spark, [("g", 0, "Me", f"😀 keep: {phrase} please", [], False), ("h", 1, "Me", " ".join(words[:12]), [], False)])
    got = [(x["guid"], x["category"], cut16(f"😀 keep: {phrase} please", x["start"], x["end"])) for x in detect.detect(r, registry=detect.Registry(words)).collect()]
    assert got == [("g", "seedPhrase", phrase)]


def test_redaction_sets(spark):
    rows = redactions(spark, [("a", 1, 4), ("a", None, None), ("b", 2, 5), ("b", 2, 5)])
    key = lambda df: sorted((r["guid"], r["start"], r["end"]) for r in df.collect())
    assert redact.absorbed(rows).count() == 2
    assert {tuple(r)[1:] for r in redact.absorbed(rows).collect()} == {("a", None, None), ("b", 2, 5)}
    assert key(redact.removed(redactions(spark, [("b", 2, 5), ("b", 6, 7)]), redactions(spark, [("b", 2, 5)]))) == [("b", 6, 7)]
    assert redact.contains(rows, redactions(spark, [("a", 7, 9), ("b", 2, 5), ("b", 2, 6)])).count() == 2
    assert redact.added(rows, redactions(spark, [("b", None, None)])).count() == 2


def test_alias_order(spark):
    r = records(spark, [("a", 0, "Them", "x", [("Alex", "👍")], False), ("b", 1, "Me", "y", [], False)])
    assert {x["label"]: x["alias"] for x in redact.anonymization_map(r).collect()} == {"Me": "P1", "Them": "P2", "Alex": "P3"}


def test_netting_against_fold(spark):
    r = random.Random(6)
    rows = [("c", r.choice("ab"), r.choice("xy"), "L", str(k), r.random() < 0.4, r.randint(0, 9), k) for k in range(300)]
    df = spark.createDataFrame(rows, "conversation_id string, target_guid string, reactor string, by string, emoji string, is_remove boolean, date long, seq long")
    state = {}
    for _, t, x, _, e, gone, *_ in sorted(rows, key=lambda q: q[-2:]):
        if gone:
            state.pop((t, x), None)
        else:
            state[t, x] = e
    assert {(q["target_guid"], q["reactor"]): q["emoji"] for q in reactions.net(df).collect()} == state


def test_reaction_order(spark):
    df = spark.createDataFrame([("c", "g", b, b, "x") for b in ("Zoe", "Me", "Ann", "Them")], "conversation_id string, target_guid string, reactor string, by string, emoji string")
    assert [x["by"] for x in reactions.by_message(df).first()["reactions"]] == ["Them", "Me", "Ann", "Zoe"]
