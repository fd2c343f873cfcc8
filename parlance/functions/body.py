"""Message bodies: attachment placeholders, reactions and the phrases of system events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space_runs, normalize_whitespace, strip

#: The placeholders a body can hold, and the emoji of reactions 2000 to 2005.
PLACEHOLDERS = ("[photo]", "[video]", "[gif]", "[audio]", "[pdf]", "[contact]", "[attachment]", "[shared location]")
TAPBACKS = {2000: "❤️", 2001: "👍", 2002: "👎", 2003: "😂", 2004: "‼️", 2005: "❓"}
#: Where an attachment stands in a text.
MARK = "￼"


def _any_of(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def placeholder(mime: Column, uti: Column, name: Column) -> Column:
    """What stands for an attachment in a body; null for the preview of a link."""
    m, u, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (mime, uti, name))
    return (
        F.when(F.coalesce(name, F.lit("")).endswith(".pluginPayloadAttachment"), None)
        .when(m.startswith("image/gif") | (u == "com.compuserve.gif"), "[gif]")
        .when(m.startswith("image/") | _any_of(u, "heic", "jpeg", "png", "image", "camera"), "[photo]")
        .when(m.startswith("video/") | _any_of(u, "quicktime", "movie", "video", "mpeg-4"), "[video]")
        .when((m == "application/pdf") | u.contains("pdf"), "[pdf]")
        .when((m == "text/vcard") | (u == "public.vcard") | n.endswith(".vcf"), "[contact]")
        .when(m.startswith("audio/") | u.contains("audio"), "[audio]")
        .otherwise("[attachment]")
    )


def render_text(raw: Column, placeholders: Column, bundle: Column) -> tuple[Column, Column]:
    """The body with a placeholder at each mark, the others behind it, and whether there was any.

    A null placeholder uses up its mark and leaves nothing there. A body that comes out empty is a shared location if
    the sender of the balloon says so.
    """
    raw = F.coalesce(raw, F.lit(""))
    held = F.coalesce(placeholders, F.array().cast("array<string>"))
    parts = F.split(raw, MARK, -1)
    at_mark = lambda i: F.coalesce(F.concat(F.lit(" "), F.get(held, i - 1), F.lit(" ")), F.lit(""))
    spliced = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(at_mark(i), p))), "")
    rest = F.filter(F.slice(held, F.size(parts), F.greatest(F.size(held), F.lit(1))), lambda p: p.isNotNull())
    whole = F.when(F.size(rest) > 0, F.concat(spliced, F.lit(" "), F.array_join(rest, " "))).otherwise(spliced)
    body = normalize_whitespace(whole)
    located = F.lower(F.coalesce(bundle, F.lit(""))).contains("findmy")
    return F.when((body == "") & located, "[shared location]").otherwise(body), F.exists(held, lambda p: p.isNotNull())


def strip_placeholders(c: Column) -> Column:
    bare = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(" ")), PLACEHOLDERS, c)
    return strip(collapse_space_runs(bare))


def target_guid(c: Column) -> Column:
    """The message a reaction is about, without the prefix that says which part of it."""
    return (
        F.when(c.startswith("p:") & c.contains("/"), F.regexp_replace(c, r"\A[^/]*/", ""))
        .when(c.startswith("p:"), F.substring(c, 3, 1 << 30))
        .when(c.startswith("bp:"), F.substring(c, 4, 1 << 30))
        .otherwise(c)
    )


def tapback(kind: Column, custom: Column) -> Column:
    """The emoji of an added (2000s) or removed (3000s) reaction."""
    known = F.create_map(*[F.lit(x) for pair in TAPBACKS.items() for x in pair])
    return F.coalesce(F.element_at(known, (kind % 1000 + 2000).cast("int")), custom, F.lit("•"))


def display_rank(by: Column) -> Column:
    return F.when(by == "Them", 0).when(by == "Me", 1).otherwise(2)


def format_reactions(reactions: Column) -> Column:
    shown = F.array_join(F.transform(reactions, lambda r: F.concat(F.lit("["), r["by"], F.lit(": "), r["emoji"], F.lit("]"))), " ")
    return F.when(F.size(reactions) > 0, F.concat(F.lit("  "), shown)).otherwise("")


def add_remove_line(actor: Column, affected: Column, added: Column) -> Column:
    verb = F.when(added, "added").otherwise("removed")
    return (
        F.when(actor.isNotNull(), F.concat(actor, F.lit(" "), verb, F.lit(" "), F.coalesce(affected, F.lit("someone"))))
        .when(affected.isNotNull(), F.concat(affected, F.lit(" was "), verb))
    )


def rename_line(actor: Column, title: Column) -> Column:
    who = F.coalesce(actor, F.lit("Someone"))
    title = strip(title)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(who, F.lit(' named the group "'), title, F.lit('"'))).otherwise(
        F.concat(who, F.lit(" cleared the group name"))
    )


def left_line(actor: Column) -> Column:
    return F.concat(actor, F.lit(" left"))
