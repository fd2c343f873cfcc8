"""SQLite message stores as Spark tables, read in place and read-only; batch and stream."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .. import schema

_TRANSIENT = ("locked", "busy", "disk i/o", "malformed", "not a database")


def connect(path: str) -> sqlite3.Connection:
    """Read-only, without ever writing beside the store; frames of a live writer's log that are committed are seen."""
    db = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def with_retry(read, attempts: int = 3, backoff: float = 0.15):
    """``read()``, again after an error that passes, such as a lock."""
    for k in range(attempts):
        try:
            return read()
        except sqlite3.DatabaseError as e:
            if k == attempts - 1 or not any(t in str(e).lower() for t in _TRANSIENT):
                raise
            time.sleep(backoff)


def columns(path: str) -> dict[str, list[str]]:
    def read():
        with closing(connect(path)) as db:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
            return {n: [r[1] for r in db.execute(f'PRAGMA table_info("{n}")')] for n in names}

    return with_retry(read)


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class StoreReader(DataSourceReader):
    """Reads ranges of ROWID side by side. ``where``, a condition in SQL, runs in SQLite.

    Filters of a query are not pushed by Spark: what it pushes into one scan of a Python source would hold for all scans
    of that table in a query, and 1:1 and group chats are two scans of one table.
    """

    def __init__(self, path: str, table: str, wanted: T.StructType, ranges: int, where: str | None = None):
        self.path, self.table, self.wanted, self.ranges, self.where = path, table, wanted, ranges, where

    def partitions(self):
        if self.ranges <= 1:
            return [_Rows(None, None)]

        def bounds():
            with closing(connect(self.path)) as db:
                return db.execute(f'SELECT MIN(ROWID), MAX(ROWID) FROM "{self.table}"').fetchone()

        low, high = with_retry(bounds)
        if low is None:
            return [_Rows(None, None)]
        step = (high - low) // self.ranges + 1
        return [_Rows(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = self.wanted.names
        have = {c.lower() for c in columns(self.path).get(self.table, [])} | {"rowid"}
        picked = ", ".join(f'"{n}"' if n.lower() in have and n != "ROWID" else "ROWID" if n == "ROWID" else "NULL" for n in names)
        where = [f"({self.where})"] if self.where else []
        values: list[int] = []
        if partition.low is not None:
            where += ["ROWID >= ?", "ROWID < ?"]
            values += [partition.low, partition.high]
        sql = f'SELECT {picked} FROM "{self.table}"' + (f" WHERE {' AND '.join(where)}" if where else "")
        kinds = [f.dataType for f in self.wanted]
        last = None
        for attempt in range(3):  # a read that has given rows is not begun again here: the task is
            try:
                with closing(connect(self.path)) as db:
                    for row in db.execute(sql, values):
                        last = row
                        yield tuple(_value(v, k) for v, k in zip(row, kinds, strict=True))
                return
            except sqlite3.DatabaseError as e:
                if last is not None or attempt == 2 or not any(t in str(e).lower() for t in _TRANSIENT):
                    raise
                time.sleep(0.15)


def _value(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.LongType):
        return int(v)
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class StoreStream(SimpleDataSourceStreamReader):
    """New rows by ROWID. Rows that change later, such as retracted messages, need a batch read to be seen."""

    def __init__(self, path: str, table: str, wanted: T.StructType, start: int):
        self.path, self.table, self.wanted, self.start = path, table, wanted, start

    def initialOffset(self):
        return {"rowid": self.start}

    def read(self, start):
        rows = list(self._between(start["rowid"], None))
        end = max([start["rowid"], *(r[0] for r in rows)])
        return iter([r[1] for r in rows]), {"rowid": end}

    def readBetweenOffsets(self, start, end):
        return iter([r[1] for r in self._between(start["rowid"], end["rowid"])])

    def _between(self, low: int, high: int | None):
        reader = StoreReader(self.path, self.table, T.StructType([T.StructField("ROWID", T.LongType()), *[f for f in self.wanted if f.name != "ROWID"]]), 1)
        for row in with_retry(lambda: list(reader.read(_Rows(low + 1, high + 1 if high is not None else 1 << 62)))):
            by_name = dict(zip(reader.wanted.names, row, strict=True))
            yield row[0], tuple(by_name[n] for n in self.wanted.names)


class StoreSource(DataSource):
    """``spark.read.format("message_store").option("path", ...).option("table", "message")``; ``ranges``: partitions;
    ``where``: a condition that SQLite checks."""

    @classmethod
    def name(cls):
        return "message_store"

    def schema(self):
        table = self.options["table"]
        return schema.table_schema(table, optional=self.options.get("optional", "false") == "true")

    def reader(self, schema: T.StructType):  # the name is part of the interface
        return StoreReader(self.options["path"], self.options["table"], schema, int(self.options.get("ranges", "1")), self.options.get("where"))

    def simpleStreamReader(self, schema: T.StructType):
        return StoreStream(self.options["path"], self.options["table"], schema, int(self.options.get("start", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoreSource)


def open_store(spark: SparkSession, path: str, ranges: int = 1) -> dict[str, DataFrame]:
    """All tables of a store that passes the schema guard, each read in place when it is used."""
    have = columns(path)
    schema.preflight(have)
    register(spark)
    optional = {c.lower() for c in schema.OPTIONAL} <= {c.lower() for c in have["message"]}
    return {
        t: spark.read.format("message_store").option("path", path).option("table", t).option("ranges", ranges).option("optional", str(optional and t == "message").lower()).load()
        for t in schema.REQUIRED
    }


def snapshot(spark: SparkSession, path: str, to: str) -> dict[str, DataFrame]:
    """Copy all tables within one transaction to Parquet: the one way to see a live store at a single point in time.

    The rows pass through the driver in batches, one table after the other.
    """
    have = columns(path)
    schema.preflight(have)
    optional = {c.lower() for c in schema.OPTIONAL} <= {c.lower() for c in have["message"]}
    with closing(connect(path)) as db:
        db.execute("BEGIN")
        for table in schema.REQUIRED:
            wanted = schema.table_schema(table, optional)
            names = ", ".join("ROWID" if n == "ROWID" else f'"{n}"' for n in wanted.names)
            cursor = db.execute(f'SELECT {names} FROM "{table}"')
            mode = "overwrite"
            while (batch := cursor.fetchmany(100_000)) or mode == "overwrite":
                rows = [tuple(_value(v, f.dataType) for v, f in zip(r, wanted, strict=True)) for r in batch]
                spark.createDataFrame(rows, wanted).write.mode(mode).parquet(f"{to}/{table}")
                mode = "append"
    return load_snapshot(spark, to)


def load_snapshot(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{at}/{t}") for t in schema.REQUIRED}


def watermark(path: str) -> int:
    """The highest ROWID of messages, by a seek; 0 if there are none. New activity shows as a higher one."""

    def read():
        with closing(connect(path)) as db:
            return db.execute("SELECT MAX(ROWID) FROM message").fetchone()[0] or 0

    return with_retry(read)
