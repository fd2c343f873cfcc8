"""Sharding by a k-d tree over document metadata, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import cut, discard

#: Dimensions of the tree: numbers, and strings as their bytes, whose order is that of the code points.
NUMBERS, STRINGS = ("size", "_id"), ("_source", "_lang")
_BINS, _TIES = 256, 4096
_DIGIT = 7  # bytes of a string that make one number


def _table(spark, names: str, rows: list[tuple[str, ...]]) -> DataFrame:
    """A table given in the plan itself, of SQL literals; it has one row per node of the tree."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS t({names})")


def _exact(v: int | None) -> str:
    return "CAST(NULL AS DECIMAL(20, 0))" if v is None else f"CAST('{v}' AS DECIMAL(20, 0))"


def _bytes(v: bytes | None) -> str:
    return "CAST(NULL AS BINARY)" if v is None else f"X'{v.hex()}'"


def _shared(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _digit(v: bytes, at: int) -> int:
    return int.from_bytes(v[at : at + _DIGIT].ljust(_DIGIT, b"\0"), "big")


def _number() -> Column:
    return F.when(F.col("_dim") == 0, F.col("size")).when(F.col("_dim") == 1, F.col("_id")).cast("decimal(20,0)")


def _string() -> Column:
    return F.when(F.col("_dim") == 2, F.col("_source")).when(F.col("_dim") == 3, F.col("_lang"))


def _tie(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "_turn"), F.lit(_TIES))


def _ends(r: Row, d: str) -> tuple:
    lo, hi = r[f"min_{d}"], r[f"max_{d}"]
    return (bytes(lo), bytes(hi)) if d in STRINGS else (lo, hi)


def _width(lo, hi, d: str, every: tuple) -> float:
    """How far apart two values are, as a part of the whole table's range; sizes by their logarithms."""
    if lo == hi:
        return 0.0
    if d in STRINGS:
        at = _shared(*every)
        return max(1e-12, (_digit(hi, at) - _digit(lo, at)) / max(1, _digit(every[1], at) - _digit(every[0], at)))
    if d == "size":
        return math.log2(hi / lo) / math.log2(every[1] / every[0])
    return (hi - lo) / (every[1] - every[0])


def shard(docs: DataFrame, leaves: int = 16, *, target_bytes: int | None = None, rows_per_bucket: int = 100_000, tries: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row of ``docs (doc_id, text, lang, source)``: law ``bytes``.

    ``size`` is the UTF-8 bytes of the text plus 1. The tree splits until it has ``leaves``, or until leaves reach
    ``target_bytes``, which says how many there are. It halves the bytes of a node (for a number of leaves that is no
    power of two, in proportion to the leaves on either side) along the node's widest dimension, relative to the whole
    table: size, id, source and language, as whole strings. The weighted median is exact: a histogram of 256 bins between
    the least and the greatest value, aggregated before its shuffle, finds the bin that holds it, and the next one is
    made of the values in that bin, until one value is left. Only rows with that very value are split by a seeded hash;
    of ``tries`` seeds the one that comes nearest is used. So any number of rows with equal metadata, such as a hot
    source, is split as well as different ones, and the sides of a cut share no other value. The driver gets one row per
    node. ``slot`` counts from 0 without gaps in each shard, over buckets of about ``rows_per_bucket`` rows.

    A null text has size 1 and the crc32 of no bytes, 0. Null metadata counts as empty, a null id as 0. Rows with equal
    ids, texts and metadata stay together unless their ids are null. Fewer rows than leaves leave shards empty. Other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda c: F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")
    at = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
            value("source").alias("_source"),
            value("lang").alias("_lang"),
            F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(0).cast("int").alias("_turn"),
            F.lit(0).cast("long").alias("_node"),
        ),
        "kd",
    )
    whole = at.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not whole["rows"]:
        return at.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if target_bytes is not None:
        leaves = max(1, -(-whole["bytes"] // target_bytes))
    parts = {0: (0, leaves)}  # node: its first leaf and number of leaves
    every = None
    while any(n > 1 for _, n in parts.values()):
        stats = at.groupBy("_node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in NUMBERS + STRINGS for f in (F.min, F.max)]
        ).collect()
        every = every or {d: _ends(stats[0], d) for d in NUMBERS + STRINGS}  # the root has all rows
        jobs = {}
        for r in stats:
            n = parts[r["_node"]][1]
            if n > 1:
                d = max(NUMBERS + STRINGS, key=lambda x: _width(*_ends(r, x), x, every[x]))  # noqa: B023
                lo, hi = _ends(r, d)
                jobs[r["_node"]] = {"dim": (NUMBERS + STRINGS).index(d), "lo": lo, "hi": hi, "goal": r["bytes"] * (n // 2) / n, "before": 0}
        last, at = at, cut(_descend(spark, at, jobs, tries), "kd")
        discard(last)
        parts = {2 * k + s: (first + s * (n // 2), (n // 2, n - n // 2)[s]) if n > 1 else (first, n) for k, (first, n) in parts.items() for s in ((0, 1) if n > 1 else (0,))}
    leaf = _table(spark, "_node, shard", [(f"{k}L", str(first)) for k, (first, _) in parts.items()])
    buckets = max(16, -(-whole["rows"] // (leaves * rows_per_bucket)))
    # One row per leaf: as many rows as shards were asked for.
    out = at.join(F.broadcast(leaf), "_node").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "_turn"), F.lit(buckets)))
    counts = out.groupBy("shard", "_bucket").count()
    starts = counts.select(
        "shard", "_bucket",
        F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size"))
    return out.join(starts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + rank - 1).cast("long").alias("slot")
    )


def _narrow(spark, at: DataFrame, jobs: dict[int, dict]) -> None:
    """Bring ``lo`` and ``hi`` of each node together at its weighted median; ``before`` is the weight below."""
    while active := {k: j for k, j in jobs.items() if j["lo"] != j["hi"]}:
        rows = []
        for k, j in active.items():
            if j["dim"] < len(NUMBERS):
                rows.append((f"{k}L", str(j["dim"]), _exact(j["lo"]), _exact(j["hi"]), _bytes(None), _bytes(None), "0", _exact(j["lo"]), f"{float(j['hi'] - j['lo'])!r}D"))
            else:
                off = _shared(j["lo"], j["hi"])
                lo, hi = _digit(j["lo"], off), _digit(j["hi"], off)
                rows.append((f"{k}L", str(j["dim"]), _exact(None), _exact(None), _bytes(j["lo"]), _bytes(j["hi"]), str(off), _exact(lo), f"{float(max(1, hi - lo))!r}D"))
        # One row per inner node of this level, fewer than there are leaves.
        plan = F.broadcast(_table(spark, "_node, _dim, _lo, _hi, _from, _to, _off, _base, _span", rows))
        digit = F.conv(F.rpad(F.hex(F.col("_s").substr(F.col("_off") + 1, F.lit(_DIGIT))), 2 * _DIGIT, "0"), 16, 10).cast("decimal(20,0)")
        binned = (
            at.join(plan, "_node").select("_node", "size", _number().alias("_v"), _string().alias("_s"), "_off", "_lo", "_hi", "_from", "_to", "_base", "_span")
            .filter(F.coalesce(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_s").between(F.col("_from"), F.col("_to"))))
            .withColumn("_place", (F.coalesce("_v", digit) - F.col("_base")).cast("double") / F.col("_span") * _BINS)
            .withColumn("_bin", F.least(F.lit(_BINS - 1), F.floor("_place")).cast("int"))
        )
        hist = binned.groupBy("_node", "_bin").agg(
            F.sum("size").alias("w"), F.min("_v").alias("v0"), F.max("_v").alias("v1"), F.min("_s").alias("s0"), F.max("_s").alias("s1")
        )
        goals = _table(spark, "_node, _left", [(f"{k}L", f"{float(j['goal'] - j['before'])!r}D") for k, j in active.items()])
        upto = Window.partitionBy("_node").orderBy("_bin")
        mid = (
            hist.withColumn("cum", F.sum("w").over(upto)).join(F.broadcast(goals), "_node")
            .filter((F.col("cum") >= F.col("_left")) & (F.col("cum") - F.col("w") < F.col("_left"))).collect()
        )
        for r in mid:
            j = jobs[r["_node"]]
            j["before"] += r["cum"] - r["w"]
            j["lo"], j["hi"] = (int(r["v0"]), int(r["v1"])) if r["v0"] is not None else (bytes(r["s0"]), bytes(r["s1"]))


def _descend(spark, at: DataFrame, jobs: dict[int, dict], tries: int) -> DataFrame:
    """Each row goes to a child of its node: left of the weighted median, or right of it."""
    _narrow(spark, at, jobs)
    points = {k: (str(j["dim"]), *((_exact(j["lo"]), _bytes(None)) if j["dim"] < len(NUMBERS) else (_exact(None), _bytes(j["lo"])))) for k, j in jobs.items()}
    plan = [(f"{k}L", *points[k], f"{float(j['goal'] - j['before'])!r}D") for k, j in jobs.items()]
    equal = lambda: F.coalesce(_number() == F.col("_at"), _string() == F.col("_at_s"))
    ties = (
        at.join(F.broadcast(_table(spark, "_node, _dim, _at, _at_s, _left", plan)), "_node").filter(equal())
        .select("_node", "size", "_left", F.posexplode(F.array(*[_tie(s) for s in range(tries)])).alias("s", "tie"))
        .groupBy("_node", "_left", "s", "tie").agg(F.sum("size").alias("w"))
    )
    upto = F.sum("w").over(Window.partitionBy("_node", "s").orderBy("tie"))
    # A cut goes behind a tie bin, or before all of them.
    edges = ties.withColumn("cut", F.col("tie") + 1).withColumn("off", F.abs(upto - F.col("_left")))
    best = {r["_node"]: r["x"] for r in edges.groupBy("_node").agg(F.min(F.struct("off", "s", "cut")).alias("x")).collect()}
    rows = []
    for k, j in jobs.items():
        x, none = best[k], abs(j["goal"] - j["before"])
        rows.append((f"{k}L", *points[k], str(x["s"]), "0" if none < x["off"] else str(x["cut"])))
    chosen = F.broadcast(_table(spark, "_node, _dim, _at, _at_s, _seed, _edge", rows))
    own = F.element_at(F.array(*[_tie(s) for s in range(tries)]), F.col("_seed") + 1)
    right = F.coalesce(_number() > F.col("_at"), _string() > F.col("_at_s")) | (equal() & (own >= F.col("_edge")))
    return at.join(chosen, "_node", "left").withColumn("_node", F.col("_node") * 2 + F.coalesce(right.cast("int"), F.lit(0))).select(*at.columns)
