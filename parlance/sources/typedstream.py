"""The text of rich message bodies, which stores hold as archived objects (the public typedstream format)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLASSES = (b"NSString", b"NSMutableString")


def decode(blob: bytes | None) -> str | None:
    """The first string object of the archive; None if there is none or the archive is broken.

    Behind the class name the archive has the string's type mark, ``+``, and its length in bytes: one byte, or 0x81 and
    two, or 0x82 and four, the least first.
    """
    if not blob or b"streamtyped" not in blob[:16]:
        return None
    places = [i + len(c) for c in _CLASSES if (i := blob.find(c)) >= 0]
    for at in sorted(places):
        plus = blob.find(b"+", at, at + 32)
        if plus < 0 or plus + 1 >= len(blob):
            continue
        n, start = blob[plus + 1], plus + 2
        if n in (0x81, 0x82):
            width = 2 if n == 0x81 else 4
            n, start = int.from_bytes(blob[start : start + width], "little"), start + width
        elif n > 0x7F:
            continue
        if start + n <= len(blob):
            try:
                return blob[start : start + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
    return None


def decode_body(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def decoded(blobs: pd.Series) -> pd.Series:
        return blobs.map(decode)

    return decoded(c)
