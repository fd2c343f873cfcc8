"""The tables of a message store, what is read of them, and the records made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Nanoseconds of the store count from 2001-01-01 UTC, this many seconds after 1970.
STORE_EPOCH = 978_307_200

#: Every table and column a store must have. ROWID is always there.
REQUIRED = {
    "handle": ("id",),
    "chat": ("chat_identifier", "service_name", "style", "display_name"),
    "chat_handle_join": ("chat_id", "handle_id"),
    "chat_message_join": ("chat_id", "message_id"),
    "message": (
        "guid", "date", "is_from_me", "handle_id", "service", "text", "attributedBody", "item_type",
        "associated_message_type", "associated_message_guid", "associated_message_emoji", "balloon_bundle_id",
        "date_retracted",
    ),
    "message_attachment_join": ("message_id", "attachment_id"),
    "attachment": ("mime_type", "uti", "transfer_name"),
}
#: Columns of ``message`` that only stores with system events have.
OPTIONAL = ("group_action_type", "group_title", "other_handle")

_TEXT = {"id", "chat_identifier", "service_name", "display_name", "guid", "service", "text", "associated_message_guid", "associated_message_emoji", "balloon_bundle_id", "mime_type", "uti", "transfer_name", "group_title"}


def column_type(name: str) -> T.DataType:
    if name == "attributedBody":
        return T.BinaryType()
    return T.StringType() if name in _TEXT else T.LongType()


def table_schema(table: str, optional: bool = False) -> T.StructType:
    names = [*(["ROWID"] if not table.startswith("chat_") else []), *REQUIRED[table], *(OPTIONAL if optional and table == "message" else ())]
    return T.StructType([T.StructField(n, column_type(n)) for n in names])


REACTIONS = "array<struct<by:string,emoji:string>>"
#: One row per message. ``date`` is in whole seconds since 1970; ``date_ns``, of the store, and ``message_rowid`` order a
#: conversation.
RECORDS = (
    "conversation_id string, message_rowid long, date_ns long, guid string, date long, speaker string, is_target boolean, "
    f"service string, text string, had_attachment boolean, reactions {REACTIONS}"
)
#: ``start`` and ``end`` are UTF-16 offsets; a whole message has neither.
REDACTIONS = "conversation_id string, guid string, start int, end int"
DETECTED = "conversation_id string, guid string, start int, end int, category string"


@dataclass(frozen=True)
class SchemaProblem:
    table: str
    column: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.column else f"{self.table} (missing table)"


class UnsupportedSchemaError(ValueError):
    def __init__(self, problems: list[SchemaProblem]):
        self.problems = problems
        super().__init__("unsupported store: " + ", ".join(map(str, problems)))


def has_columns(df: DataFrame, names) -> bool:
    return {n.lower() for n in names} <= {c.lower() for c in df.columns}


def schema_problems(columns: dict[str, list[str]]) -> list[SchemaProblem]:
    """Every gap in a store given as its tables and their columns; a missing table is one gap. Case does not matter."""
    have = {t.lower(): {c.lower() for c in cs} for t, cs in columns.items()}
    out = []
    for table, names in REQUIRED.items():
        if table not in have:
            out.append(SchemaProblem(table))
        else:
            out += [SchemaProblem(table, n) for n in names if n.lower() not in have[table]]
    return out


def preflight(columns: dict[str, list[str]]) -> None:
    if problems := schema_problems(columns):
        raise UnsupportedSchemaError(problems)


@dataclass(frozen=True)
class TrimOptions:
    drop_attachment_placeholders: bool = False
    drop_reactions: bool = False

    @property
    def is_active(self) -> bool:
        return self.drop_attachment_placeholders or self.drop_reactions


@dataclass(frozen=True)
class FuzzyRule:
    min_subset_ratio: float = 0.6
    max_roster_delta: int = 3
    min_jaccard: float = 0.8
    min_roster_size: int = 3


DETECTORS = ("password", "ssn", "creditCard", "seedPhrase", "apiKey", "standingCode", "bankAccount")
SCRUBBERS = ("phone", "email", "postalAddress", "otp")


@dataclass(frozen=True)
class Scope:
    """What of a conversation is exported, and how. ``date_range`` is inclusive, in seconds since 1970."""

    date_range: tuple[int, int] | None = None
    trim: TrimOptions = TrimOptions()
    anonymize_speakers: bool = False
    show_system_events: bool = False
    enabled_scrubbers: frozenset[str] = frozenset()
    enabled_detectors: frozenset[str] = frozenset(DETECTORS)

    def __post_init__(self):
        unknown = (set(self.enabled_scrubbers) - set(SCRUBBERS)) | (set(self.enabled_detectors) - set(DETECTORS))
        if unknown:
            raise ValueError(f"unknown categories: {', '.join(sorted(unknown))}")
