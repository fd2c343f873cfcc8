"""Toxicity by a linear classifier whose scores are held equal when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_sparse, sigmoid
from .shared import cut, fold, small_batches

_WORD = re.compile(r"[^\W\d_]+")
_BITS = 20
#: Words that name groups of people. Within a line, each can stand for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "mexican", "arab", "chinese", "indian"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "old", "young"),
    ("mujeres", "hombres"), ("frauen", "männer"), ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"),
)
_OTHERS = {w: tuple(x for x in line if x != w) for line in IDENTITIES for w in line}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """A word counts as itself, by how it begins and by the runs of letters in it."""
    whole = f"<{word}>"
    found = {whole, *(whole[:k] for k in range(4, min(len(whole), 10)))}
    if len(whole) <= 40:
        found.update(whole[i : i + 5] + "~" for i in range(1, len(whole) - 4))
    return [xxhash.xxh32_intdigest(f) & ((1 << _BITS) - 1) for f in found]


def indices(bag: set[str]) -> np.ndarray:
    return np.array([i for w in sorted(bag) for i in features(w)], np.int32)


def swapped(bag: set[str], turn: int) -> set[str] | None:
    """The words with each identity term changed for another of its line; None without such terms."""
    if not (own := sorted(bag & _OTHERS.keys())):
        return None
    return (bag - set(own)) | {_OTHERS[w][turn % len(_OTHERS[w])] for w in own}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of a partition each feature occurs, and in how many toxic ones; -1 stands for any text."""
    n, bad = np.zeros((2, (1 << _BITS) + 1), np.int64)
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            f = np.append(np.unique(indices(words(text))), -1)
            n[f] += 1
            bad[f] += int(y == 1)
    f = np.flatnonzero(n)
    yield pd.DataFrame({"f": np.where(f == 1 << _BITS, -1, f), "n": n[f], "bad": bad[f]})


def _encode(chosen):
    """The chosen features of each text, by their places among all that were chosen, and those of its twin."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << _BITS, -1, np.int32)
        place[chosen.value] = np.arange(len(chosen.value))

        def placed(bag: set[str] | None) -> bytes | None:
            if bag is None:
                return None
            at = place[indices(bag)]
            return at[at >= 0].tobytes()

        for batch in batches:
            bags = [words(t) for t in batch["text"]]
            other = [swapped(bag, int(i)) for bag, i in zip(bags, batch["doc_id"], strict=True)]
            yield pd.DataFrame({"y": batch["y"], "x": [placed(b) for b in bags], "z": [placed(o) for o in other]})

    return encode


def _entries(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(a) for a in arrays]
    return np.repeat(np.arange(len(arrays)), lengths), np.concatenate([*arrays, np.empty(0, np.int32)])


class Model:
    """Weights of the hashed features that matter, and the bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.weight, self.bias = dict(zip(index.tolist(), weight.tolist(), strict=True)), bias
        self._word: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        """Words add up, so each kind of word is weighed once and then looked up."""
        total, known = self.bias, self._word
        for w in words(text):
            s = known.get(w)
            if s is None:
                if len(known) > 300_000:
                    known.clear()
                s = known[w] = sum(self.weight.get(i, 0.0) for i in features(w))
            total += s
        return float(sigmoid(np.array(total)))


def train(
    docs: DataFrame, labels: DataFrame, *, sample: int = 6000, keep: int = 3000, pull: float = 2.0, parts: int = 4, held: int = 2
) -> Model:
    """Fit on about ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The features that tell most about the label are fitted: one for two rows, 200 at least and ``keep`` at most. ``pull`` weighs the counterfactual penalty.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold("doc_id", parts) != held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    n = known.count()
    part = min(1_000_000, sample * 1_000_000 // max(1, n))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part
    # About ``sample`` ids; the same hash keeps other documents out before the join.
    texts = cut(docs.select("doc_id", "text").filter(chosen).join(F.broadcast(known.filter(chosen)), "doc_id"), "sample")
    counts = texts.mapInPandas(_count, "f int, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = counts.filter("f = -1").first()
    rows, bad = (every["n"], every["bad"]) if every else (0, 0)
    if bad in (0, rows):
        share = (bad + 0.5) / (rows + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    base = bad / rows
    gain = (F.col("bad") - F.col("n") * base) ** 2 / (F.col("n") * (base * (1 - base)) + 1.0)
    best = counts.filter("f >= 0 AND n > 1").sort(gain.desc(), "f").limit(min(keep, max(200, rows // 2))).select("f").collect()
    index = np.array(sorted(r["f"] for r in best), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    found = texts.select("doc_id", "text", "y").mapInPandas(_encode(shared), "y int, x binary, z binary").toPandas()
    y = found["y"].to_numpy(np.float64)
    arrays = lambda c: _entries([np.frombuffer(x, np.int32) for x in c])
    r, c = arrays(found["x"])
    twins = found["z"].notna()
    pairs = (*arrays(found["x"][twins]), *arrays(found["z"][twins])) if twins.any() else None
    w, b = fit_sparse(r, c, y, len(index), pairs, pull)
    return Model(index, w, b)


def _scores(model):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [m.score(t) for t in batch["text"]]})

    return score


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, parts: int = 4, held: int = 2, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``, by a model fitted on ``labels (doc_id, toxic)``.

    Training texts that name groups of people get a twin with other groups named, and differences between the scores
    of twins are penalised, so that naming a group says nothing by itself. Scores come from the whole text alone.

    A null text is scored as one without words, by the bias. Rows that share an id are each scored; a label counts for
    all of them, the higher one where labels differ. Null labels, and labels all alike, leave a constant score. A null
    id is not held out. An empty table gives an empty result. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, parts=parts, held=held, **training))
    out = docs.select("doc_id", "text").mapInPandas(_scores(model), "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def acceptable(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those predicted toxic. Rows that share an id go together; rows with a null id stay."""
    gone = toxicity(docs, labels, **parameters).filter("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
