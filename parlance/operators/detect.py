"""Detectors of secrets and scrubbers of personal data, as spans of texts.

The rules are this library's own. Detectors flag and remove nothing; scrubbers are off unless asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import find_spans, no_spans
from ..functions.text import utf16_slice
from ..schema import DETECTORS, SCRUBBERS

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@dataclass(frozen=True)
class Rule:
    """A pattern of one category. ``grouped``: group 1 leads up to group 2, the value; else the whole match is it.
    ``valid`` looks at the value found."""

    category: str
    pattern: str
    grouped: bool = False
    valid: Callable[[Column], Column] | None = None

    def spans(self, text: Column) -> Column:
        found = find_spans(text, self.pattern, 1, 2) if self.grouped else find_spans(text, self.pattern)
        if self.valid is None:
            return found
        return F.filter(found, lambda s: self.valid(utf16_slice(text, s["start"], s["end"])))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = _digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d) & ~d.rlike(r"^(\d)\1+$")


def _ssn(c: Column) -> Column:
    d = _digits(c)
    return ~F.substring(d, 1, 3).isin("000", "666") & ~d.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _mod97(c: Column) -> Column:
    """An IBAN: the first four characters go behind the rest, letters count from 10, and what is left over is 1."""
    s = F.upper(F.regexp_replace(c, " ", ""))
    chars = F.filter(F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), ""), lambda x: x != "")
    add = lambda r, x: F.when(x.rlike("[0-9]"), (r * 10 + x.cast("int")) % 97).otherwise((r * 100 + F.ascii(x) - 55) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(chars, F.lit(0), add) == 1)


def _aba(c: Column) -> Column:
    weights = (3, 7, 1) * 3
    total = sum((F.substring(c, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    return (total % 10 == 0) & (c != "000000000")


_KEYWORD = r"(?i)\b(?:%s)\b[^\n\p{L}\d]{0,3}(?:(?:(?:is|was|to|number|no|code)\b|[=:])[^\n\p{L}\d]{0,3}){0,2}"

DETECTOR_RULES: tuple[Rule, ...] = (
    Rule("password", rf"({_KEYWORD % 'password|passwd|passcode|passphrase|pwd'})([^\s\"',;]{{4,64}})", True),
    Rule("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", valid=_ssn),
    Rule("creditCard", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", valid=_luhn),
    Rule("apiKey", r"\b(?:sk-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("apiKey", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("apiKey", r"((?i)\b(?:api_?key|secret|token)\s{0,3}[=:]\s{0,3}[\"'])([0-9A-Za-z_-]{32,})", True),
    Rule("standingCode", rf"({_KEYWORD % '(?:door|gate|garage|alarm|entry|lockbox|building) (?:code|pin)|pin|keypad'})(#?\d{{4,8}}#?)(?!\d)", True),
    Rule("bankAccount", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", valid=_mod97),
    Rule("bankAccount", rf"({_KEYWORD % 'routing|aba|rtn'})(\d{{9}})(?!\d)", True, _aba),
)

SCRUBBER_RULES: tuple[Rule, ...] = (
    Rule("email", r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    Rule("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"),
    Rule("phone", r"(?<![\w+])\+\d{8,15}(?!\d)"),
    Rule("postalAddress", r"\b\d{1,6} (?:[A-Z][A-Za-z.]{1,20} ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way)\b\.?(?:,? (?:Apt|Unit|Suite|#) ?\w{1,6})?(?:, [A-Z][A-Za-z ]{1,30},? [A-Z]{2} \d{5}(?:-\d{4})?)?"),
    Rule("otp", r"(?<![\w#])#\d{6}(?!\d)"),
    Rule("otp", r"\bG-\d{6}(?!\d)"),
    Rule("otp", r"((?i)\b(?:verification|security|login) code(?: is|:)? )(\d{4,8})(?!\d)", True),
)


def seed_phrases(wordlist: Iterable[str]) -> Callable[[Column], Column]:
    """Spans of 12, 15, 18, 21 or 24 words of a list of 2048 whose checksum holds; the list is a parameter."""
    words = sorted(wordlist)
    if len(words) != 2048:
        raise ValueError("a list has 2048 words")
    index = {w: i for i, w in enumerate(words)}

    def holds(ids: list[int]) -> bool:
        bits = "".join(f"{i:011b}" for i in ids)
        n = len(bits) * 32 // 33
        digest = hashlib.sha256(int(bits[:n], 2).to_bytes(n // 8, "big")).digest()
        return f"{digest[0]:08b}"[: len(bits) - n] == bits[n:]

    def find(text: str | None) -> list[dict]:
        found, last = [], 0
        tokens = [(m.start(), m.end(), index.get(m.group().lower())) for m in re.finditer(r"[A-Za-z]+", text or "")]
        at = 0
        while at < len(tokens):
            size = next((n for n in (24, 21, 18, 15, 12) if at + n <= len(tokens) and all(t[2] is not None for t in tokens[at : at + n]) and holds([t[2] for t in tokens[at : at + n]])), 0)
            if size:
                a, b = tokens[at][0], tokens[at + size - 1][1]
                wide = len(text[:a].encode("utf-16-le")) // 2
                found.append({"start": wide, "end": wide + len(text[a:b].encode("utf-16-le")) // 2})
                last = at + size
            at = max(at + 1, last)
        return found

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    return spans


class Registry:
    """Rules by category. More can be added; ``seed_words`` turns on the one detector that needs a word list."""

    def __init__(self, seed_words: Iterable[str] | None = None):
        self.rules = [*DETECTOR_RULES, *SCRUBBER_RULES]
        self.custom: dict[str, list[Callable[[Column], Column]]] = {}
        if seed_words is not None:
            self.custom["seedPhrase"] = [seed_phrases(seed_words)]

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def spans(self, text: Column, category: str) -> Column:
        every = [r.spans(text) for r in self.rules if r.category == category] + [f(text) for f in self.custom.get(category, [])]
        return F.array_sort(F.array_distinct(F.concat(*every))) if every else no_spans()


def _found(records: DataFrame, categories: Iterable[str], known: Iterable[str], registry: Registry) -> DataFrame:
    wanted = [c for c in known if c in set(categories)]
    text = F.col("text")

    def named(c: str) -> Column:
        return F.transform(registry.spans(text, c), lambda s: F.struct(F.lit(c).alias("category"), s["start"].alias("start"), s["end"].alias("end")))

    per = [named(c) for c in wanted]
    every = F.concat(*per) if per else F.expr("cast(array() as array<struct<category:string,start:int,end:int>>)")
    return records.filter("guid IS NOT NULL").select("conversation_id", "guid", F.explode(every).alias("x")).select("conversation_id", "guid", "x.start", "x.end", "x.category")


def detect(records: DataFrame, enabled: Iterable[str] = DETECTORS, registry: Registry | None = None) -> DataFrame:
    """``(conversation_id, guid, start, end, category)``: the secrets in texts with a guid."""
    return _found(records, enabled, DETECTORS, registry or Registry())


def scrub(records: DataFrame, enabled: Iterable[str], registry: Registry | None = None) -> DataFrame:
    """The spans that enabled scrubbers redact, as ``schema.REDACTIONS``."""
    return _found(records, enabled, SCRUBBERS, registry or Registry()).drop("category")


def values(records: DataFrame, category: str, registry: Registry | None = None) -> DataFrame:
    """``(guid, value)``: what is found in each text, cut out of its own row; ids may be null or stand for several texts."""
    found = records.select("guid", "text", F.explode((registry or Registry()).spans(F.col("text"), category)).alias("x"))
    return found.select("guid", utf16_slice(F.col("text"), F.col("x.start"), F.col("x.end")).alias("value"))
