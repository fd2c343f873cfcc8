"""Phone numbers, handles and the labels of speakers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calling codes by region; any other region counts as US.
CALLING_CODES = {
    "US": "1", "CA": "1", "GB": "44", "FR": "33", "DE": "49", "AU": "61",
    "IE": "353", "ES": "34", "IT": "39", "NL": "31", "MX": "52", "JP": "81",
}
ME, THEM = "Me", "Them"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{N}+", "")


def normalize_phone(c: Column, region: Column | str = "US") -> Column:
    """E.164 as well as can be told; null for an address or fewer than 7 digits.

    A plus is authoritative, 11 digits with a leading 1 are a North American number, and any other number loses one
    leading 0 and gets the calling code of the region.
    """
    if isinstance(region, str):
        code = F.lit(CALLING_CODES.get(region.upper(), "1"))
    else:
        codes = F.create_map(*[F.lit(x) for pair in CALLING_CODES.items() for x in pair])
        code = F.coalesce(F.element_at(codes, F.upper(region)), F.lit("1"))
    d = digits(c)
    return (
        F.when(c.contains("@") | (F.length(d) < 7), None)
        .when(c.contains("+") | ((F.length(d) == 11) & d.startswith("1")), F.concat(F.lit("+"), d))
        .otherwise(F.concat(F.lit("+"), code, F.regexp_replace(d, "^0", "")))
    )


def normalize_handle(c: Column, region: Column | str = "US") -> Column:
    return F.when(c.contains("@"), F.lower(c)).otherwise(F.coalesce(normalize_phone(c, region), c))


def display_number(c: Column) -> Column:
    """``(AAA) BBB-CCCC`` for 10 digits, or 11 with a leading 1; anything else, and any address, as it is."""
    d = digits(c)
    national = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).when(F.length(d) == 10, d)
    shown = F.concat(
        F.lit("("), F.substring(national, 1, 3), F.lit(") "), F.substring(national, 4, 3), F.lit("-"), F.substring(national, 7, 4)
    )
    return F.when(c.contains("@"), c).otherwise(F.coalesce(shown, c))


def name_parts(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def first_token(c: Column) -> Column:
    return F.coalesce(F.get(name_parts(c), F.lit(0)), c)


def last_initial(c: Column) -> Column:
    parts = name_parts(c)
    return F.when(F.size(parts) >= 2, F.upper(F.substring(F.element_at(parts, -1), 1, 1)))


def speaker_label(is_from_me: Column, is_target: Column, label: Column, handle_id: Column) -> Column:
    return F.when(is_from_me, ME).when(is_target, THEM).otherwise(F.coalesce(label, F.concat(F.lit("h"), handle_id.cast("string"))))


def system_event_label(is_from_me: Column, label: Column, on_roster: Column, handle_id: Column) -> Column:
    """Who a system event is about; null where nobody is recorded.

    Labels of roster members are final. Others are shaped: a number is made readable and a name loses all but its
    first part.
    """
    pretty = display_number(label)
    shaped = F.when(pretty.rlike(r"@|\p{N}"), pretty).otherwise(first_token(pretty))
    return (
        F.when(is_from_me, ME)
        .when(handle_id == 0, None)
        .when(label.isNull(), F.concat(F.lit("h"), handle_id.cast("string")))
        .when(on_roster, label)
        .otherwise(shaped)
    )


def aliasable(c: Column) -> Column:
    """A label that is a name: neither generic nor a number."""
    return ~c.isin(ME, THEM) & c.rlike(r"\p{L}")
