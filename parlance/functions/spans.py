"""Spans of a text in UTF-16 units: finding, merging, splicing, and mapping offsets to the text that comes out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_length, utf16_slice

REDACTED = "[redacted]"
#: Spaces in front of each further line of a body.
INDENT = 8
SPAN = "struct<start:int,end:int>"
REPLACEMENT = "struct<start:int,end:int,token:string,redaction:boolean>"


def no_spans(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def find_spans(text: Column, pattern: Column | str, lead: int | None = None, value: int | None = None) -> Column:
    """``array<struct<start, end>>`` of the matches of a pattern that matches no empty text.

    With ``lead`` and ``value``, groups that follow each other from the start of a match, the spans are those of
    ``value``. A span begins behind all gaps and matches before it.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, regex, -1), lambda x: utf16_length(x))
    group = lambda k: F.transform(F.regexp_extract_all(text, regex, F.lit(k)), lambda x: utf16_length(x))
    sizes = F.arrays_zip(
        gaps.alias("gap"), group(0).alias("all"),
        (group(lead) if lead is not None else F.transform(gaps, lambda g: F.lit(0))).alias("lead"),
        (group(value) if value is not None else group(0)).alias("size"),
    )
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    step = lambda s, x: F.when(x["all"].isNull(), s).otherwise(
        F.struct(
            (s["at"] + x["gap"] + x["all"]).alias("at"),
            F.array_append(
                s["out"],
                F.struct(
                    (s["at"] + x["gap"] + x["lead"]).alias("start"), (s["at"] + x["gap"] + x["lead"] + x["size"]).alias("end")
                ),
            ).alias("out"),
        )
    )
    found = F.aggregate(sizes, start, step, lambda s: s["out"])
    return F.when(text.rlike(pattern) if isinstance(pattern, str) else F.rlike(text, regex), found).otherwise(no_spans())


def merge_spans(spans: Column, length: Column) -> Column:
    """Spans within bounds, in order; those that overlap or touch become one. Empty and other spans are dropped."""
    valid = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= length) & (s["start"] < s["end"]))
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.array_append(
        F.slice(a, 1, F.size(a) - 1),
        F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end")),
    )
    return F.aggregate(
        F.array_sort(F.transform(valid, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))),
        no_spans(),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.get(a, F.size(a) - 1)["end"]), joined(a, s)).otherwise(F.array_append(a, s)),
    )


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(replacements: Column) -> Column:
    """Replacements in order of their starts, each only if it overlaps none before it; ties keep their order."""
    ordered = F.array_sort(
        F.transform(replacements, lambda r, i: F.struct(r["start"].alias("s"), i.alias("i"), r.alias("r")))
    )
    return F.aggregate(
        F.transform(ordered, lambda x: x["r"]), no_spans(REPLACEMENT),
        lambda a, r: F.when(F.exists(a, lambda x: overlap(x, r)), a).otherwise(F.array_append(a, r)),
    )


def alias_replacements(text: Column, aliases: Column) -> Column:
    """Whole words of the text that are a label of ``aliases (label, alias)``, in any case; longest labels first."""
    regex = lambda x: F.concat(F.lit(r"(?iuU)\b\Q"), F.replace(x["label"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    found = F.transform(
        F.filter(aliases, lambda x: x["label"] != ""),
        lambda x: F.transform(
            find_spans(text, regex(x)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), x["alias"].alias("token"), F.lit(False).alias("redaction")),
        ),
    )
    return F.flatten(found)


def body_replacements(text: Column, redactions: Column, aliases: Column | None = None) -> Column:
    """What is spliced into a body: merged redactions, and aliases where they meet none."""
    merged = F.transform(
        merge_spans(redactions, utf16_length(text)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(REDACTED).alias("token"), F.lit(True).alias("redaction")),
    )
    if aliases is None:
        return merged
    clear = F.filter(alias_replacements(text, aliases), lambda a: ~F.exists(merged, lambda r: overlap(a, r)))
    return apart(F.concat(merged, clear))


def splice(text: Column, replacements: Column) -> Column:
    """The text with each of the ordered, separate replacements in its place."""
    starts = F.transform(replacements, lambda r, i: F.when(i == 0, F.lit(0)).otherwise(F.get(replacements, i - 1)["end"]))
    pieces = F.transform(
        F.arrays_zip(replacements.alias("r"), starts.alias("from")),
        lambda x: F.concat(utf16_slice(text, x["from"], x["r"]["start"]), x["r"]["token"]),
    )
    tail = utf16_slice(text, F.element_at(replacements, -1)["end"], utf16_length(text))
    return F.when(F.size(replacements) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def segments(text: Column, replacements: Column) -> Column:
    """``array<struct<src_start, src_end, out_start, fixed>>``, which maps a text to its spliced and indented body.

    A plain segment ends behind each line break that stays, and the next begins ``INDENT`` further on; a replaced one
    (``fixed``) is one point. The last segment is empty and stands at the end.
    """
    n = utf16_length(text)
    breaks = F.transform(find_spans(text, "\n"), lambda s: s["end"])
    kept = F.filter(breaks, lambda b: ~F.exists(replacements, lambda r: (b > r["start"]) & (b <= r["end"])))
    edges = F.array_sort(
        F.array_distinct(
            F.concat(F.array(F.lit(0), n), kept, F.transform(replacements, lambda r: r["start"]), F.transform(replacements, lambda r: r["end"]))
        )
    )
    fixed = lambda a: F.get(F.filter(replacements, lambda r: r["start"] == a), F.lit(0))
    start = F.struct(F.lit(0).alias("out"), F.expr("cast(array() as array<struct<src_start:int,src_end:int,out_start:int,fixed:boolean>>)").alias("segs"))

    def step(s: Column, x: Column) -> Column:
        a, b = x["a"], x["b"]
        rep = fixed(a)
        width = F.when(rep.isNotNull(), F.length(rep["token"])).otherwise(b - a + F.when(F.array_contains(kept, b), INDENT).otherwise(0))
        seg = F.struct(a.alias("src_start"), b.alias("src_end"), s["out"].alias("out_start"), rep.isNotNull().alias("fixed"))
        return F.struct((s["out"] + width).alias("out"), F.array_append(s["segs"], seg).alias("segs"))

    pairs = F.filter(
        F.transform(edges, lambda e, i: F.struct(e.alias("a"), F.get(edges, i + 1).alias("b"))), lambda x: x["b"].isNotNull()
    )
    end = lambda s: F.array_append(
        s["segs"], F.struct(n.alias("src_start"), n.alias("src_end"), s["out"].alias("out_start"), F.lit(False).alias("fixed"))
    )
    return F.aggregate(pairs, start, step, end)


def source_to_output(segs: Column, offset: Column) -> Column:
    """Where an offset of the source comes out; within a replaced span, at the start of its token."""
    at = F.greatest(F.lit(0), F.least(offset, F.element_at(segs, -1)["src_start"]))
    seg = F.element_at(F.filter(segs, lambda s: s["src_start"] <= at), -1)
    return F.when(seg["fixed"], seg["out_start"]).otherwise(seg["out_start"] + at - seg["src_start"])


def is_inside_redaction(segs: Column, offset: Column) -> Column:
    """Is the offset of the source within a replaced span; its end is not."""
    return F.exists(segs, lambda s: s["fixed"] & (s["src_start"] <= offset) & (offset < s["src_end"]))


def output_to_source(segs: Column, offset: Column) -> Column:
    """Where an offset of the body comes from: within a token the start of its span, within an indent the line's."""
    before = F.filter(segs, lambda s: s["out_start"] <= offset)
    seg = F.coalesce(F.get(before, F.size(before) - 1), F.element_at(segs, 1))
    within = F.least(offset - seg["out_start"], seg["src_end"] - seg["src_start"])
    following = F.coalesce(F.get(segs, F.greatest(F.size(before), F.lit(1)))["src_start"], F.element_at(segs, -1)["src_start"])
    return F.when(seg["fixed"], seg["src_start"]).otherwise(F.least(seg["src_start"] + within, following))
