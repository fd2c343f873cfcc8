"""Cutting plans at tables in the shared folder, and joins that spread hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster it is an error."""
    context = spark.sparkContext
    at = context.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="parlance-"))
        at = context.getCheckpointDir()
    return at


def cut(df: DataFrame, name: str = "t", *, hashes: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the plan starts there, and lost executors cost nothing that came before.

    ``hashes``: most of it is hashes, of which Parquet should not try to make a dictionary."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def passing(spark: SparkSession, path: str) -> None:
    """Have ``sweep`` delete this folder."""
    if not _tables:
        atexit.register(sweep)
    _tables.append((spark, path))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made, once everything that reads them has been written itself."""
    for df in tables:
        path = df.cut_path
        _delete(df.sparkSession, path)
        _tables[:] = [(s, p) for s, p in _tables if p != path]


def sweep() -> None:
    """Delete the intermediate tables of this process. Results that still read them must have been used by then."""
    while _tables:
        _delete(*_tables.pop())


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        return


def join_spread(big: DataFrame, small: DataFrame, key: str, count: str, by: tuple[str, ...], parts: int = 64) -> DataFrame:
    """``big`` joined with ``small``, which has one row per ``key`` and the ``count`` of its rows in ``big``, which it loses.

    The rows of a key that has a thousandth of all counted rows are dealt to ``parts`` tasks by a hash of ``by``. There are
    at most a thousand such keys, whatever the size of the tables; they alone are broadcast. Every key has its rows in
    ``small`` once for each part.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * 1000 > total
    named = F.broadcast(small.filter(hot).select(F.col(key).alias("_hot")))
    dealt = big.join(named, big[key] == F.col("_hot"), "left").withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.lit(parts)))).drop("_hot")
    copies = small.withColumn("_deal", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop(count)
    return dealt.withColumn("_deal", F.col("_deal").cast("int")).join(copies, [key, "_deal"]).drop("_deal")
