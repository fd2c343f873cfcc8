"""Columns over text: white space, UTF-16 offsets, JSON strings, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends of text lose: Unicode space separators, tab, and the control and line separators below.
_SPACE = r"\p{Zs}\t\n\r\x0B\x0C\x1C-\x1F\x{85}\x{2028}\x{2029}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{_SPACE}]+|[{_SPACE}]+\z", "")


def collapse_space_runs(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t]+", " ")


def normalize_whitespace(c: Column) -> Column:
    """Each line with runs of spaces and tabs made one and its ends stripped; then the ends of the whole."""
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), lambda x: strip(collapse_space_runs(x))), "\n"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the coordinates of all spans."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_slice(c: Column, start: Column, end: Column) -> Column:
    part = F.substring(F.encode(c, "UTF-16BE"), start * 2 + 1, (end - start) * 2)
    return F.decode(part, "UTF-16BE")


def json_string(c: Column) -> Column:
    """A JSON string literal: only quotes, backslashes and control characters are escaped, the latter in lower case."""
    named = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = [(chr(k), named.get(chr(k), f"\\u{k:04x}")) for k in range(0x20)]
    escaped = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), controls, quoted)
    return F.concat(F.lit('"'), F.when(quoted.rlike(r"[\x00-\x1F]"), escaped).otherwise(quoted), F.lit('"'))


def comma(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)
