from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import body, identity, spans, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("zero_")).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "region", "want"),
    [
        ("07911 123456", "GB", "+447911123456"), ("06 12 34 56 78", "FR", "+33612345678"), ("1 503 555 0146", "US", "+15035550146"),
        ("+1 (503) 555-0146", "US", "+15035550146"), ("+44 7911 123456", "US", "+447911123456"), ("5035550146", "US", "+15035550146"),
        ("123", "US", None), ("a@b.c", "US", None), ("5035550146", "ZZ", "+15035550146"),
    ],
)
def test_normalize_phone(spark, raw, region, want):
    assert one(spark, identity.normalize_phone(F.col("a"), region), a=raw) == want
    assert one(spark, identity.normalize_phone(F.col("a"), F.col("r")), a=raw, r=region) == want


@pytest.mark.parametrize(("raw", "want"), [("+18443996927", "(844) 399-6927"), ("8443996927", "(844) 399-6927"), ("x@y.z", "x@y.z"), ("+447911123456", "+447911123456"), ("Ann", "Ann")])
def test_display_number(spark, raw, want):
    assert one(spark, identity.display_number(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    ("mime", "uti", "name", "want"),
    [
        ("image/gif", None, None, "[gif]"), (None, "com.compuserve.gif", None, "[gif]"), ("image/jpeg", None, None, "[photo]"), (None, "public.heic", None, "[photo]"),
        ("video/quicktime", None, None, "[video]"), (None, "public.mpeg-4", None, "[video]"), ("application/pdf", None, None, "[pdf]"), ("text/vcard", None, None, "[contact]"),
        (None, None, "Ann.VCF", "[contact]"), ("audio/amr", None, None, "[audio]"), (None, None, "a.pluginPayloadAttachment", None), (None, None, None, "[attachment]"),
    ],
)
def test_placeholder(spark, mime, uti, name, want):
    string = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(body.placeholder(string(mime), string(uti), string(name)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    ("raw", "held", "bundle", "want"),
    [
        ("look ￼", ["[photo]"], None, ("look [photo]", True)), ("see ￼ link ￼", [None, "[pdf]"], None, ("see link [pdf]", True)), ("hi", ["[audio]"], None, ("hi [audio]", True)),
        ("  a \t b  \n  c ", [], None, ("a b\nc", False)), (None, [], "com.apple.findmy", ("[shared location]", False)), (None, [], None, ("", False)), ("￼", [None], None, ("", False)),
    ],
)
def test_render_text(spark, raw, held, bundle, want):
    df = spark.createDataFrame([(raw, held, bundle)], "raw string, held array<string>, bundle string")
    shown, had = body.render_text(F.col("raw"), F.col("held"), F.col("bundle"))
    assert tuple(df.select(shown.alias("a"), had.alias("b")).first()) == want


@pytest.mark.parametrize("s", ["plain", 'q"uo\\te', "a\nb\tc\rd\be\ff", "\x01\x1f", "é😀 ", ""])
def test_json_string(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(text.json_string(F.col("s")).alias("x")).first()["x"] == json.dumps(s, ensure_ascii=False)


def test_small_ones(spark):
    assert one(spark, text.comma(F.col("a")), a=1234567) == "1,234,567"
    for raw, want in (("p:0/X", "X"), ("p:X", "X"), ("bp:X", "X"), ("X", "X")):
        assert one(spark, body.target_guid(F.col("a")), a=raw) == want
    assert one(spark, body.strip_placeholders(F.col("a")), a="hey [photo] you [shared location]") == "hey you"
    assert one(spark, text.utf16_length(F.col("a")), a="a😀b") == 4
    assert one(spark, identity.first_token(F.col("a")), a=" Ann  Lee") == "Ann"
    assert one(spark, identity.last_initial(F.col("a")), a="Ann lee") == "L"


def _merge(found, n):
    out = []
    for a, b in sorted(s for s in found if 0 <= s[0] < s[1] <= n):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _u16(s):
    return s.encode("utf-16-be")


def test_spans_against_python(spark):
    r = random.Random(4)
    rows = []
    for k in range(150):
        s = "".join(r.choice("ab \n😀é") for _ in range(r.randint(0, 25)))
        n = len(_u16(s)) // 2
        ends = [0]  # offsets between characters
        for c in s:
            ends.append(ends[-1] + len(_u16(c)) // 2)
        rows.append((k, s, [(a, b) for a, b in ((r.choice(ends), r.choice([*ends, n + 3])) for _ in range(r.randint(0, 5)))]))
    df = spark.createDataFrame(rows, "k int, s string, found array<struct<start:int,end:int>>")
    reps = spans.body_replacements(F.col("s"), F.col("found"))
    df = df.withColumn("reps", reps).withColumn("out", spans.splice(F.col("s"), F.col("reps"))).withColumn("segs", spans.segments(F.col("s"), F.col("reps")))
    df = df.withColumn("n", text.utf16_length(F.col("s")))
    places = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: spans.source_to_output(F.col("segs"), i))
    for row in df.withColumn("places", places).withColumn("bs", spans.find_spans(F.col("s"), "b+")).collect():
        raw, n = _u16(row["s"]), row["n"]
        merged = _merge([tuple(x) for x in row["found"]], n)
        assert [(x["start"], x["end"]) for x in row["reps"]] == merged
        want, at = b"", 0
        for a, b in merged:
            want += raw[at * 2 : a * 2] + _u16("[redacted]")
            at = b
        assert row["out"] == (want + raw[at * 2 :]).decode("utf-16-be")
        place, out = {}, 0
        k = 0
        while k < n:
            hit = next((m for m in merged if m[0] == k), None)
            if hit:
                place.update(dict.fromkeys(range(hit[0], hit[1]), out))
                out, k = out + 10, hit[1]
            else:
                place[k] = out
                out += 9 if raw[k * 2 : k * 2 + 2] == _u16("\n") else 1
                k += 1
        assert row["places"] == [place[i] for i in range(n)] + [out]
        import re

        assert [(x["start"], x["end"]) for x in row["bs"]] == [(len(_u16(row["s"][: m.start()])) // 2, len(_u16(row["s"][: m.end()])) // 2) for m in re.finditer("b+", row["s"])]


def test_offsets_back(spark):
    df = spark.createDataFrame([("0123456789ab", [(2, 8)])], "s string, r array<struct<start:int,end:int>>")
    df = df.withColumn("segs", spans.segments(F.col("s"), spans.body_replacements(F.col("s"), F.col("r"))))
    back = [df.select(spans.output_to_source(F.col("segs"), F.lit(k)).alias("x")).first()["x"] for k in (0, 1, 2, 5, 11, 12, 13, 16)]
    assert back == [0, 1, 2, 2, 2, 8, 9, 12]
    df = spark.createDataFrame([("a\nb",)], "s string").withColumn("segs", spans.segments(F.col("s"), F.expr("cast(array() as array<struct<start:int,end:int,token:string,redaction:boolean>>)")))
    assert [df.select(spans.output_to_source(F.col("segs"), F.lit(k)).alias("x")).first()["x"] for k in (0, 1, 2, 6, 10, 11)] == [0, 1, 2, 2, 2, 3]


def test_touching_and_nested(spark):
    for found, want in (([(7, 12), (10, 15)], "secret [redacted] tail"), ([(7, 15), (9, 12)], "secret [redacted] tail"), ([(7, 9), (9, 15)], "secret [redacted] tail"), ([(40, 50), (3, 3)], "secret ABCDEFGH tail")):
        df = spark.createDataFrame([("secret ABCDEFGH tail", found)], "s string, r array<struct<start:int,end:int>>")
        assert df.select(spans.splice(F.col("s"), spans.body_replacements(F.col("s"), F.col("r"))).alias("x")).first()["x"] == want
