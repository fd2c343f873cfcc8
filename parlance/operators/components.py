"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard, join_spread


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges (a, b)``; a component is named by its least node.

    Each step hangs the larger neighbours of a node on the least one, then the smaller ones with the node itself; the
    number of steps grows with the logarithm of the longest path. Minima are taken before the shuffle and joined back by
    ``join_spread``, so the edges of a node with very many neighbours go to many tasks. Every step is a table in the
    shared folder.
    """
    now = cut(
        edges.filter("a <> b").select(F.least("a", "b").alias("m"), F.greatest("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("x")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("x")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("x")).alias("m"), F.count("*").alias("n")), "least")
        large = join_spread(both, least, "u", "n", ("x",)).filter("x > u").select("m", F.col("x").alias("v")).filter("v <> m").distinct()
        large = cut(large, "large")
        small = cut(large.groupBy("v").agg(F.min("m").alias("l"), F.count("*").alias("n")), "least")
        hung = join_spread(large, small, "v", "n", ("m",))
        last_edges, now = now, cut(
            hung.select(F.col("l").alias("m"), F.col("m").alias("v")).unionByName(hung.select(F.col("l").alias("m"), "v")).filter("v <> m").distinct(),
            "small",
        )
        discard(last_edges, large, least, small)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
        now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("m", "v") % 1_000_000_007).alias("s")).first()
    return r["n"], r["s"] or 0
