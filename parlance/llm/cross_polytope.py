"""Embedding near-deduplication by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import cut, join_spread

_BLOCK = 512  # members of a bucket that are compared at once
_SMALL = 24  # up to so many, groups are compared together


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hash:
    """``tables`` tables of ``parts`` cross-polytopes each. A vector has ``parts + 1`` buckets in each table: the one of
    its nearest polytope vertices, and for each part the one with the second nearest vertex there."""

    def __init__(self, dim: int, parts: int, tables: int, seed: int = 9):
        self.dim, self.parts, self.tables = dim, parts, tables
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), (tables, parts, 3, self.width))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """For each row, ``tables * (parts + 1)`` numbers; a number belongs to one table."""
        n = len(x)
        padded = np.zeros((n, self.width))
        padded[:, : self.dim] = x
        out = np.empty((n, self.tables, self.parts + 1), np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            first, second = np.empty((2, n, self.parts), np.int64)
            for p in range(self.parts):
                y = padded
                for signs in self.signs[t, p]:
                    y = hadamard(y * signs)
                size = np.abs(y)
                a = size.argmax(axis=1)
                size[rows, a] = -1
                b = size.argmax(axis=1)
                first[:, p], second[:, p] = 2 * a + (y[rows, a] < 0), 2 * b + (y[rows, b] < 0)
            for q in range(self.parts + 1):
                code = np.full(n, t + 1, np.uint64)
                for p in range(self.parts):
                    v = second[:, p] if q == p + 1 else first[:, p]
                    code = (code ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    code ^= code >> np.uint64(29)
                out[:, t, q] = ((code >> np.uint64(10)) | (np.uint64(t) << np.uint64(54))).view(np.int64)
        return out.reshape(n, -1)


def plan(dim: int, count: int, least: float, recall: float = 0.99, most: int = 256) -> Hash:
    """Parts so that a bucket has 16 vectors at most on average, and as many tables as random pairs at exactly
    the least cosine need to share a bucket with probability ``recall``; such pairs are the hardest to find. Where more
    than ``most`` tables would be needed, as with a low ``least``, there is no plan."""
    width = 1 << max(1, (dim - 1).bit_length())
    parts = max(1, min(6, math.ceil(math.log(max(count, 2) / 16) / math.log(2 * width))))
    if dim < 2:
        return Hash(dim, 1, 1)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = least * a + math.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables = 8
    while True:
        h = Hash(dim, parts, tables)
        x, y = (h.buckets(v).reshape(len(v), tables, -1) for v in (a, b))
        hit = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3))
        share = (np.cumsum(hit, axis=1) > 0).mean(axis=0)
        if share[-1] >= recall:
            return Hash(dim, parts, int(np.argmax(share >= recall)) + 1)
        if tables >= most:
            raise ValueError(f"{tables} tables find {share[-1]:.3f} of the pairs at a cosine of {least}, not {recall}")
        tables *= 2


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, dims, raw = [], [], []
        for v in batch["embedding"]:
            x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
            if x is None or len(x) == 0 or not np.isfinite(x).all() or not x.any():
                keys.append(None), dims.append(0), raw.append(None)
                continue
            b = x.astype(np.float32).tobytes() if (x.astype(np.float32) == x).all() else x.tobytes()
            keys.append(xxhash.xxh3_128_digest(b)), dims.append(len(x)), raw.append(b)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "_key": keys, "_dim": dims, "_raw": raw})


def _unit(raw, dim: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in raw], np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _post(h: Hash):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"_key": batch["_key"], "_buckets": list(h.buckets(_unit(batch["_raw"], h.dim)))})

    return post


def _compare(h: Hash, least: float):
    """Counts and a spanning forest of the links between the members of each block pair of a bucket.

    A pair that meets in several buckets counts in the first one it shares.
    """

    def found(batch: pd.DataFrame, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        """One row per member of the links between rows ``a`` and ``b``."""
        bucket, size, keys = (batch[c].to_numpy() for c in ("_bucket", "_size", "_key"))
        used = np.unique(np.concatenate((a, b)))
        place = np.zeros(len(x), np.int64)
        place[used] = np.arange(len(used))
        codes = h.buckets(x[used])
        links = np.zeros(len(x), np.int64)
        for at in range(0, len(a), 20_000):
            p, q = a[at : at + 20_000], b[at : at + 20_000]
            u, v = codes[place[p]].reshape(len(p), h.tables, -1), codes[place[q]].reshape(len(p), h.tables, -1)
            shared = (u[:, :, :, None] == v[:, :, None, :]).any(axis=3)
            first = np.where(shared, u, np.iinfo(np.int64).max).reshape(len(p), -1).min(axis=1)
            own = first == bucket[p]
            np.add.at(links, p[own], size[q[own]])
            np.add.at(links, q[own], size[p[own]])
        root = np.arange(len(x))  # the least member that links lead to
        while True:
            last = root.copy()
            np.minimum.at(root, a, last[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == last).all():
                break
        return pd.DataFrame({"_key": keys[used], "_links": links[used], "_to": keys[root[used]]})

    def groups(batch: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        """Small groups all at once, by the list of their pairs; each large one as a product of matrices."""
        x, block = _unit(batch["_raw"], h.dim), batch["_block"].to_numpy()
        across = (batch["_i"] != batch["_j"]).to_numpy()
        n = ends - starts
        small = np.flatnonzero((n > 1) & (n <= _SMALL))
        near = []
        for m in np.unique(n[small]):
            rows = starts[small[n[small] == m]]
            p, q = np.triu_indices(m, 1)
            for at in range(0, len(rows), max(1, 100_000 // len(p))):
                some = rows[at : at + max(1, 100_000 // len(p)), None]
                a, b = (some + p).ravel(), (some + q).ravel()
                same = (np.einsum("ij,ij->i", x[a], x[b]) >= least) & (~across[a] | (block[a] != block[b]))
                near.append((a[same], b[same]))
        if near:
            a, b = (np.concatenate(y) for y in zip(*near, strict=True))
            if len(a):
                yield found(batch, x, a, b)
        for s, e in zip(starts[n > _SMALL], ends[n > _SMALL], strict=True):
            part = np.triu(x[s:e] @ x[s:e].T >= least, 1)
            if across[s]:
                part &= block[s:e, None] != block[None, s:e]
            a, b = np.nonzero(part)
            if len(a):
                yield found(batch.iloc[s:e], x[s:e], a, b)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            same = (batch[["_bucket", "_i", "_j"]].to_numpy()[1:] == batch[["_bucket", "_i", "_j"]].to_numpy()[:-1]).all(axis=1)
            edges = np.array([0, *(np.flatnonzero(~same) + 1)])
            yield from groups(batch, edges[:-1], edges[1:])
            rest = batch.iloc[edges[-1] :]
        if rest is not None and len(rest) > 1:
            yield from groups(rest.reset_index(drop=True), np.array([0]), np.array([len(rest)]))

    return compare


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.99) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors (vec_id, embedding)``.

    Equal vectors form one class and are hashed once; members of a class link to each other and to what the class links
    to. Each class goes into its buckets (see ``Hash``; ``plan`` sets parts and tables), every bucket is cut into blocks
    of about 512 members, and every pair of blocks is compared exactly, in double precision: no bucket is capped, none
    is one task, and what leaves a block pair is one row per member, not one per pair.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither do vectors
    of different lengths with each other. Rows that share an id are taken row by row; the component gets the least id.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    rows = cut(vectors.select("vec_id", "embedding").mapInPandas(_vectors, "vec_id long, _key binary, _dim int, _raw binary"), "vectors")
    classes = cut(
        rows.filter("_key IS NOT NULL").groupBy("_key").agg(
            F.count("*").alias("_size"), F.min("vec_id").alias("_first"), F.first("_dim").alias("_dim"), F.first("_raw").alias("_raw")
        ),
        "classes",
    )
    links = None
    for r in classes.groupBy("_dim").count().collect():  # a table has one length of vectors, or few
        part = _links(classes.filter(F.col("_dim") == r["_dim"]), plan(r["_dim"], r["count"], least, recall), least)
        links = part if links is None else links.unionByName(part)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links, "links")
    named = components(links.select(F.col("_key").alias("a"), F.col("_to").alias("b")))
    sums = links.groupBy("_key").agg(F.sum("_links").alias("_links"))
    joined = classes.select("_key", "_size", "_first").join(sums, "_key", "left").join(named.withColumnRenamed("node", "_key"), "_key", "left")
    joined = cut(joined, "joined")
    first = cut(joined.filter("component IS NOT NULL").groupBy("component").agg(F.min("_first").alias("_least"), F.count("*").alias("_k")), "first")
    linked = join_spread(joined.filter("component IS NOT NULL"), first, "component", "_k", ("_key",))
    alone = joined.filter("component IS NULL").withColumn("_least", F.col("_first"))
    each = linked.unionByName(alone).select("_key", (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), F.coalesce("_least", "_first").alias("_c"), "_size")
    known = join_spread(rows.filter("_key IS NOT NULL").select("vec_id", "_key"), cut(each, "each"), "_key", "_size", ("vec_id",)).select("vec_id", "_n", "_c")
    none = rows.filter("_key IS NULL").select("vec_id", F.lit(0).cast("long").alias("_n"), F.col("vec_id").alias("_c"))
    return known.unionByName(none).select(
        "vec_id", F.col("_n").cast("long").alias("n_links"), F.col("_c").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("_c")).alias("kept")
    )


def _links(classes: DataFrame, h: Hash, least: float) -> DataFrame:
    """Links of each class. Posts hold keys only; a class's vector joins them where its bucket has others to compare with.

    Of buckets that hold the same classes, as those of a cluster do in most tables, the one with the least number stands
    for all; it is the first that two of its members share."""
    posts = cut(classes.select("_key", "_raw").mapInPandas(_post(h), "_key binary, _buckets array<long>"), "posts")
    posts = posts.select("_key", F.explode("_buckets").alias("_bucket"))
    mark = F.xxhash64("_key")
    full = cut(
        posts.groupBy("_bucket").agg(F.count("*").alias("_m"), F.bit_xor(mark).alias("_x"), F.sum(F.pmod(mark, F.lit(1_000_000_007))).alias("_s")).filter("_m > 1")
        .groupBy("_m", "_x", "_s").agg(F.min("_bucket").alias("_bucket")).select("_bucket", "_m", F.ceil(F.col("_m") / _BLOCK).cast("int").alias("_blocks")),
        "full",
    )
    posts = join_spread(posts, full, "_bucket", "_m", ("_key",))
    block = F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")
    pairs = posts.withColumn("_block", block).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_bucket", F.least("_block", "_x").alias("_i"), F.greatest("_block", "_x").alias("_j"), "_block", "_key"
    ).join(classes.select("_key", "_raw", "_size"), "_key")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(n, "_bucket", "_i", "_j").sortWithinPartitions("_bucket", "_i", "_j")
    return pairs.mapInPandas(_compare(h, least), "_key binary, _links long, _to binary")


#: The same rows from all pairs; for small tables.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.9),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
degree AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""
