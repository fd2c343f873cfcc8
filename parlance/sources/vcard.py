"""vCard files as contacts: a name, and at most a photo, for each normalized handle."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import normalize_phone

_ESCAPE = re.compile(r"\\(.)")


def _plain(value: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] in "nN" else m[1], value).strip()


def _fields(value: str) -> list[str]:
    """Parts of a structured value, divided by semicolons that aren't escaped."""
    return [_plain(p) for p in re.split(r"(?<!\\);", value)]


def parse(text: str) -> Iterator[tuple[int, str, str, str, bytes | None]]:
    """``(card, kind, value, name, photo)`` for each telephone number and address of each card that has a name.

    The name is given and family name, or else the organization. Folded lines are joined first.
    """
    lines = re.sub(r"\r?\n[ \t]", "", text).replace("\r\n", "\n").split("\n")
    card, held = -1, None
    for line in lines:
        head, _, value = line.partition(":")
        key, *parameters = head.split(";")
        key = key.rpartition(".")[2].upper()
        if key == "BEGIN":
            card, held = card + 1, {"names": "", "org": "", "handles": [], "photo": None}
        elif held is None:
            continue
        elif key == "N":
            family, given, *_ = [*_fields(value), "", ""]
            held["names"] = " ".join(p for p in (given, family) if p)
        elif key == "ORG":
            held["org"] = _fields(value)[0]
        elif key in ("TEL", "EMAIL"):
            held["handles"].append((key, _plain(value.removeprefix("tel:"))))
        elif key == "PHOTO":
            data = value.partition("base64,")[2] or value
            try:
                held["photo"] = base64.b64decode(data, validate=True) if data and not data.startswith("http") else None
            except (binascii.Error, ValueError):
                held["photo"] = None
        elif key == "END":
            name = held["names"] or held["org"]
            if name:
                yield from ((card, k, v, name, held["photo"]) for k, v in held["handles"])
            held = None


def contacts(spark: SparkSession, path: str, region: str = "US") -> DataFrame:
    """``(handle, name, photo)``: handles are normalized, and the first card of a file, in order, has each of them.

    Each file is parsed as a whole by one task; files are read side by side.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = [(name, *x[:4], x[4], k) for k, x in enumerate(parse(content.decode("utf-8", "replace")))]
                yield pd.DataFrame(found, columns=["file", "card", "kind", "value", "name", "photo", "place"])

    cards = files.mapInPandas(rows, "file string, card long, kind string, value string, name string, photo binary, place long")
    handle = F.when(F.col("kind") == "EMAIL", F.lower("value")).otherwise(normalize_phone(F.col("value"), region))
    keyed = cards.withColumn("handle", handle).filter("handle IS NOT NULL")
    first = Window.partitionBy("handle").orderBy("file", "card", "place")
    photo = F.first("photo", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return keyed.select("handle", "name", photo.alias("photo"), F.row_number().over(first).alias("k")).filter("k = 1").drop("k")


def no_contacts(spark: SparkSession) -> DataFrame:
    """What stands for contacts that can't be had."""
    return spark.createDataFrame([], "handle string, name string, photo binary")
