"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_epochs: int = 2
) -> DataFrame:
    """One row per source, ``(source, source_size)``, gets its ``target`` (double).

    Sources, by code point with null last, weigh ``weights``, repeating, and share ``share[0]/share[1]`` of all sizes.
    A target stops at ``max_epochs`` times its source's size and the excess goes to the others by weight, until none is
    above. Clamping again and again ends where the sources with the smallest size per weight are clamped, so one
    ordered pass over the sources finds the same fixed point: in the order of cap per weight a source is clamped
    exactly if its part of what the ones before leave reaches its cap. All sums are integers; each target is one
    division. Sources may be as many as hosts: both orders are dealt to tasks by range (``_running``), and only sums
    per task meet in one place.
    """
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    num, den = share
    placed = _running(sizes.withColumn("_null", F.col("source").isNull()), ("_null", "source"), _pos=F.lit(1).cast("long"))
    weighed = (
        placed.withColumn("_w", F.element_at(w, (F.col("_pos") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .drop("_null")
    )
    filled = _running(weighed, ("_ratio", "_pos"), _before=F.col("_cap"), _lighter=F.col("_w"))
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("weight")).first()
    # A literal below 2**31 is an int, whose products overflow, and those of many words and many sources a long.
    size, weight = (F.lit(total[c] or 0).cast("decimal(38,0)") for c in ("size", "weight"))
    left = size * num - F.col("_before") * den
    clamped = left * F.col("_w") >= F.col("_cap") * (weight - F.col("_lighter")) * den
    filled = cut(filled.withColumn("_clamped", clamped), "filled")
    ends = filled.agg(F.sum(F.when(F.col("_clamped"), F.col("_cap"))).alias("capped"), F.sum(F.when(~F.col("_clamped"), F.col("_w"))).alias("open")).first()
    free, weight = (total["size"] or 0) * num - (ends["capped"] or 0) * den, (ends["open"] or 1) * den
    shared = (F.col("_w") * F.lit(free).cast("long")).cast("double") / F.lit(weight).cast("double")
    return filled.select("source", "source_size", F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def _running(rows: DataFrame, order: tuple[str, ...], **columns: Column) -> DataFrame:
    """``rows`` with the sum of each of ``columns`` over all rows before, in an order without ties.

    Rows are dealt to tasks by ranges of the order and written, so that the ranges stay as they are; sums run within each,
    and what the ranges before add is one row per range."""
    values = {f"_v{k}": c for k, c in enumerate(columns.values())}
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns(values)
    dealt = cut(dealt, "dealt")
    ranges = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"{v}_sum") for v in values])
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over_ranges, within = ahead(Window.orderBy("_range")), ahead(Window.partitionBy("_range").orderBy(*order))
    bases = ranges.select("_range", *[F.coalesce(F.sum(f"{v}_sum").over(over_ranges), F.lit(0)).alias(f"{v}_base") for v in values])
    out = dealt.join(F.broadcast(bases), "_range")  # a row per shuffle partition at most
    sums = {name: F.col(f"{v}_base") + F.coalesce(F.sum(v).over(within), F.lit(0)) for name, v in zip(columns, values, strict=True)}
    return out.withColumns(sums).select(*rows.columns, *columns)


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: str = "mix",
    buckets: int = 4096,
) -> DataFrame:
    """``(doc_id, size, source_size, target, repeats, taken)`` for every row of ``docs (doc_id, source, text)``.

    A document is repeated ``floor(target / source_size)`` times. The rest of the target goes to documents in a seeded
    order of ids, one more repetition each, up to the place nearest to the target, so a source misses its target by
    half a document at most. Running sums stay within ``(source, bucket of the order)``; only one sum per bucket
    crosses sources, so a source with a third of all rows is split over ``buckets`` groups.

    Nulls: a null source is a source of its own, a null or blank text has size 0 and takes 0, a null id is ordered
    first. Rows with equal ids are taken one by one. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_bucket", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % buckets)
    key = ["_null", "_source", "_bucket"]
    sums = cut(rows.groupBy(*key).agg(F.sum("size").alias("_sum")), "sums")
    of_source = Window.partitionBy("_null", "_source")
    plan = targets(
        sums.groupBy(F.when(~F.col("_null"), F.col("_source")).alias("source")).agg(F.sum("_sum").alias("source_size")),
        weights, share, max_epochs,
    ).select(
        F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"),
        "source_size", "target",
    )
    bases = sums.withColumn(
        "_base",
        F.coalesce(
            F.sum("_sum").over(of_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).join(plan, ["_null", "_source"])
    upto = Window.partitionBy(*key).orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        rows.join(bases, key)
        .withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("_whole", whole.cast("long"))
        .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn(
            "repeats",
            F.col("_whole")
            + (
                (F.col("_whole") < max_epochs)
                & (F.col("_need") > 0)
                & (F.col("_before") * 2 + F.col("size") <= F.col("_need") * 2)
            ).cast("long"),
        )
        .select(
            "doc_id", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken")
        )
    )


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as ``mix`` repeats it. ``doc_id`` identifies a row here: where
    ids repeat, the repetitions of the first row in the order of the mix hold for all rows with the id."""
    repeats = (
        mix(docs, **parameters).groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max("repeats").alias("_mix_repeats"))
    )
    out = docs.join(repeats, docs["doc_id"].eqNullSafe(F.col("_mix_id")) & (F.col("_mix_repeats") > 0))
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_repeats").cast("int")))).select(
        *[docs[f"`{c}`"] for c in docs.columns]
    )


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM rows GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((pos - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w, source_size * 2 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes),
filled AS (
  SELECT *, (total * 3 - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) * 2) * w
            >= cap * CAST(sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) * 2 AS clamped
  FROM weighed),
levels AS (
  SELECT *, coalesce(CAST(sum(cap) FILTER (clamped) OVER () AS BIGINT), 0) AS capped,
         CAST(sum(w) FILTER (NOT clamped) OVER () AS BIGINT) AS free FROM filled),
goals AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (total * 3 - capped * 2) AS DOUBLE) / CAST(free * 2 AS DOUBLE) END AS target FROM levels),
placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(CAST(sum(r.size) OVER (PARTITION BY r.source
           ORDER BY CAST('0x' || substr(r.o, 1, 8) AS BIGINT) % 4096, r.o, r.doc_id, r.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN whole < 2 AND target - whole * source_size > 0
                             AND ahead * 2 + size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END) AS taken
FROM placed
"""
