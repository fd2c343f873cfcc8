"""MinHash near-deduplication over an inverted index of signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import cut, discard, join_spread, small_batches
from .shingles import set_id, shingle_set, signature

#: Coordinates of a signature, and how many must agree. At a similarity of 0.75, 24 of 32 agree on average; fewer than
#: 12 do in about one pair of a million.
COORDINATES, AGREE = 32, 12
#: Members of a list that are compared at once: so many, or with so many shingles.
_BLOCK, _BLOCK_SHINGLES = 512, 2_000_000


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets],
            "_set": [set_id(s) if len(s) else None for s in sets],
            "_sig": [signature(s, COORDINATES) if len(s) else None for s in sets], "_text": batch["_text"],
        })


def _whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, s) for k, t in zip(batch["_set"], batch["text"], strict=True) if set_id(s := shingle_set(t)) == bytes(k)]
        yield pd.DataFrame({"_set": [k for k, _ in rows], "_all": [s.tobytes() for _, s in rows]})


def _confirmed(percent: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["_x"], batch["_y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return check


def _collisions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates each signature of ``x`` agrees with each of ``y``."""
    both = np.zeros((len(x), len(y)), np.uint8)
    for c in range(x.shape[1]):
        both += x[:, c, None] == y[None, :, c]
    return both


def _common(few: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of sets, as a product of 0/1 matrices over the shingles that several have."""
    every = few + sets
    _, col = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shared = np.bincount(col)[col] > 1
    row, (_, col) = row[shared], np.unique(col[shared], return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(few), len(sets)), np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    step = max(1, min(width, 4_000_000 // len(every)))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(col, (at, at + step))
        dense = np.zeros((len(every), step), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        both += dense[: len(few)] @ dense[len(few) :].T
    return both


def _blocks(percent: int):
    """Links between components within each block pair of a list: one for every two components that have any."""

    def links(part: pd.DataFrame) -> pd.DataFrame | None:
        """Members on the one side that agree with some on the other in enough coordinates are compared as whole sets."""
        side = part["_side"].to_numpy()
        if not side.any() or side.all():
            return None
        sig = np.stack(part["_sig"].to_numpy())
        keys, code = np.unique(part["_c"].map(bytes).to_numpy(), return_inverse=True)
        n, few, rest = part["_n"].to_numpy(), np.flatnonzero(side), np.flatnonzero(~side)
        near = (_collisions(sig[few], sig[rest]) >= AGREE) & (code[few, None] != code[None, rest])
        near &= 100 * np.minimum(n[few, None], n[None, rest]) >= percent * np.maximum(n[few, None], n[None, rest])
        few, rest, near = few[near.any(axis=1)], rest[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        if not len(few):
            return None
        sets = {k: np.frombuffer(part["_all"].iat[k], np.uint64) for k in {*few.tolist(), *rest.tolist()}}
        both = _common([sets[k] for k in few.tolist()], [sets[k] for k in rest.tolist()])
        x, y = np.nonzero(near & (100 * both >= percent * (n[few, None] + n[None, rest] - both)))
        if not len(x):
            return None
        x, y = few[x], rest[y]
        _, first = np.unique(code[x] * len(keys) + code[y], return_index=True)
        ids = part["_set"].to_numpy()
        return pd.DataFrame({"a": ids[x[first]], "b": ids[y[first]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            at = batch[["_key", "_i", "_j"]].to_numpy()
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(batch)]
            for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
                if hi - lo > 1 and (found := links(batch.iloc[lo:hi])) is not None:
                    yield found
            rest = batch.iloc[edges[-2] :]
        if rest is not None and len(rest) > 1 and (found := links(rest)) is not None:
            yield found

    return compare


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs (doc_id, text)``.

    Two documents are linked if their sets of five-word shingles have 100 * intersection >= ``percent`` * union.
    Documents with equal sets form one class and are represented once. A class is posted under its signature's
    coordinate-value pairs. Pairs with ``AGREE`` agreeing coordinates share one of the ``n - AGREE + 1`` rarest pairs
    that each of the two shares with anything at all, in one global order of frequency, so only those are posted
    (prefix) and the long lists are skipped; what the skipped lists would add is counted on the two signatures. Pairs
    that agree often enough are confirmed on whole sets.

    A list of many near copies isn't expanded into pairs. First its most typical member is compared with all others.
    In lists that still hold several components, all members outside the largest one are dealt to blocks, and so are all
    members. In every pair of blocks collisions of all coordinates are counted for all pairs at once, and those that
    agree in ``AGREE`` are confirmed on whole sets there; what leaves a block pair is one link for two components. So
    collisions are counted for every pair of a list whose members are not connected already.

    A null or blank text has no shingles and links to nothing. Rows that share an id are taken row by row, and the
    component gets the least id; all rows with that id count as kept. A null id never names a component unless the
    component has no other. An empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    prints = cut(
        docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInPandas(_fingerprints, "doc_id long, n_shingles long, _set binary, _sig array<long>, _text long"),
        "prints",
    )
    classes = cut(
        prints.filter("_set IS NOT NULL").groupBy("_set").agg(
            F.min("doc_id").alias("_first"), F.min_by("_text", F.struct("doc_id", "_text")).alias("_text"),
            F.first("n_shingles").alias("_n"), F.first("_sig").alias("_sig"), F.count("*").alias("_rows"),
        ),
        "classes",
    )
    posts = cut(_prefixes(classes), "posts")
    agreed = cut(_agreeing(_with_typical(posts, percent), classes), "agreed")
    links = _confirm(agreed, classes, docs, percent)
    discard(agreed)
    named = cut(components(links), "named")
    more = _rest(posts, named, classes, docs, percent)
    discard(posts)
    if not more.isEmpty():
        named = cut(components(links.unionByName(more)), "named")
    joined = cut(classes.select("_set", "_first", "_rows").join(named.withColumnRenamed("node", "_set"), "_set", "left"), "joined")
    least = cut(joined.filter("component IS NOT NULL").groupBy("component").agg(F.min("_first").alias("_m"), F.count("*").alias("_k")), "least")
    linked = join_spread(joined.filter("component IS NOT NULL"), least, "component", "_k", ("_set",))
    alone = joined.filter("component IS NULL").withColumn("_m", F.lit(None).cast("long"))
    each = cut(linked.unionByName(alone).select("_set", F.coalesce("_m", "_first").alias("_least"), "_rows"), "each")
    rows = prints.select("doc_id", "n_shingles", "_set")
    known = join_spread(rows.filter("_set IS NOT NULL"), each, "_set", "_rows", ("doc_id",))
    out = known.unionByName(rows.filter("_set IS NULL").withColumn("_least", F.col("doc_id")))
    return out.select(
        "doc_id", "n_shingles", F.col("_least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("_least")).alias("kept")
    )


def _prefixes(classes: DataFrame) -> DataFrame:
    """The rarest shared coordinate-value pairs of each class, as far as the prefix goes."""
    posts = classes.select(F.explode("_sig").alias("_key"), "_set", "_n")
    shared = cut(posts.groupBy("_key").agg(F.count("*").alias("_f")).filter("_f > 1"), "shared")
    found = join_spread(posts, shared.withColumn("_rows", F.col("_f")), "_key", "_rows", ("_set",))
    lists = found.groupBy("_set", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "_key"))).alias("_l"))
    return (
        lists.filter(F.size("_l") >= AGREE)
        .withColumn("_weight", F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.log2(x["_f"].cast("double"))))
        .select(F.explode(F.slice("_l", 1, F.size("_l") - (AGREE - 1))).alias("_x"), "_set", "_n", "_weight")
        .select("_x._key", "_set", "_n", "_weight")
    )


def _with_typical(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member of a list with the one whose pairs are met most often, if their sizes allow a link."""
    lead = cut(posts.groupBy("_key").agg(F.max(F.struct("_weight", "_set", "_n")).alias("_lead"), F.count("*").alias("_rows")), "lead")
    a, b = F.least("_set", "_lead._set").alias("a"), F.greatest("_set", "_lead._set").alias("b")
    near = F.least("_n", "_lead._n") * 100 >= F.greatest("_n", "_lead._n") * percent
    return join_spread(posts, lead, "_key", "_rows", ("_set",)).filter((F.col("_set") != F.col("_lead._set")) & near).select(a, b).distinct()


def _rest(posts: DataFrame, named: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between what is left in different components of one list."""
    posts = posts.join(named.withColumnRenamed("node", "_set"), "_set", "left").select("_key", "_set", "_n", F.coalesce("component", "_set").alias("_c"))
    parts = lambda m, s: F.ceil(F.greatest(F.col(m) / _BLOCK, F.col(s) / _BLOCK_SHINGLES)).cast("int")
    several = cut(
        posts.groupBy("_key", "_c").agg(F.count("*").alias("_m"), F.sum("_n").alias("_s"))
        .groupBy("_key").agg(F.max(F.struct("_m", "_c", "_s")).alias("_top"), F.count("*").alias("_cs"), F.sum("_m").alias("_m"), F.sum("_s").alias("_s"))
        .filter("_cs > 1").withColumn("_few", F.col("_m") - F.col("_top._m")).withColumn("_few_s", F.col("_s") - F.col("_top._s"))
        .select("_key", F.col("_top._c").alias("_main"), parts("_m", "_s").alias("_all_parts"), parts("_few", "_few_s").alias("_few_parts"), F.col("_m").alias("_rows")),
        "several",
    )
    left = cut(join_spread(posts, several, "_key", "_rows", ("_set",)), "left")
    sets = _sets(left.select("_set").distinct(), classes, docs).join(classes.select("_set", "_sig"), "_set")
    # Those outside the largest component meet all members: in rows of block pairs on the one side, in columns on the other.
    block = lambda n: F.pmod(F.xxhash64("_set"), F.col(n)).cast("int")
    turns = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = left.filter("_c <> _main").select("_key", block("_few_parts").alias("_i"), turns("_all_parts").alias("_j"), "_set", "_c", "_n", F.lit(True).alias("_side"))
    every = left.select("_key", turns("_few_parts").alias("_i"), block("_all_parts").alias("_j"), "_set", "_c", "_n", F.lit(False).alias("_side"))
    pairs = few.unionByName(every).join(sets, "_set")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(n, "_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
    more = cut(dealt.mapInPandas(_blocks(percent), "a binary, b binary"), "more")
    discard(left)
    return more


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``AGREE`` coordinates."""
    sig = classes.select("_set", "_sig")
    both = pairs.join(sig.toDF("a", "_x"), "a").join(sig.toDF("b", "_y"), "b")
    agree = F.size(F.filter(F.zip_with("_x", "_y", lambda x, y: x == y), lambda same: same))
    return both.filter(agree >= AGREE).select("a", "b")


def _sets(need: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(_set, _all)``: the whole sets of the classes that are asked for, from their first documents' texts.

    A text is found by its id and its hash, so rows that share an id, or null, don't all meet."""
    need = need.join(classes.select("_set", "_first", "_text"), "_set")
    found = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    texts = need.join(found, (F.col("_text") == F.col("_hash")) & F.col("_first").eqNullSafe(F.col("_id")))
    return cut(texts.select("_set", "text").mapInPandas(_whole_sets, "_set binary, _all binary").dropDuplicates(["_set"]), "sets")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    need = pairs.select(F.col("a").alias("_set")).unionByName(pairs.select(F.col("b").alias("_set"))).distinct()
    sets = _sets(need, classes, docs)
    both = pairs.join(sets.toDF("b", "_y"), "b").join(sets.toDF("a", "_x"), "a").select("a", "b", "_x", "_y")
    links = cut(both.mapInPandas(_confirmed(percent), "a binary, b binary"), "links")
    discard(sets)
    return links


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least id. Null ids stay."""
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")




#: The same rows from an exact join on shingles; for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
