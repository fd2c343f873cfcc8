"""Quality by compression: two zstandard dictionaries, of good and of bad text, and what each saves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_dense, sigmoid
from .shared import fold, small_batches

#: Texts are compressed in pieces of so many bytes, so that what a text teaches the compressor does not hide the dictionaries.
_LEVEL, _PIECE, _DICTIONARY = 3, 160, 110 << 10


def dictionary(texts: list[str], size: int = _DICTIONARY) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train one."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    parameters = {"level": _LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not data:
        return zstandard.ZstdCompressor(**parameters)
    known = zstandard.ZstdCompressionDict(data)
    known.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(**parameters, dict_data=known)


class Measure:
    """The normalised difference of a whole text: what good text's dictionary saves over bad text's, per byte."""

    def __init__(self, good: bytes, bad: bytes):
        self._good, self._bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        more = 0
        for i in range(0, len(data), _PIECE):
            piece = data[i : i + _PIECE]
            more += len(self._bad.compress(piece)) - len(self._good.compress(piece))
        return more / (len(data) + 1)


class Model:
    """Both dictionaries and the calibration, a logistic curve over the difference."""

    def __init__(self, good: bytes, bad: bytes, slope: float, bias: float):
        self.good, self.bad, self.slope, self.bias = good, bad, slope, bias

    def scores(self, texts) -> np.ndarray:
        measure = Measure(self.good, self.bad)
        return sigmoid(np.array([measure(t) for t in texts], np.float64) * self.slope + self.bias)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, longest: int = 256 << 10, parts: int = 5, held: int = 0) -> Model:
    """Fit on about ``sample`` rows of either label outside the held-out fold, chosen by a hash of the id.

    Texts of more than ``longest`` bytes don't train. Half of the rows make the dictionaries, the other half calibrates
    the score, so that no text is measured by a dictionary that holds it.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold("doc_id", parts) != held)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    part = lambda y: min(1_000_000, sample * 1_000_000 // max(1, counts.get(y, 0)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.filter(chance < F.when(F.col("y") == 1, part(1)).otherwise(part(0)))
    # About twice ``sample`` ids; the same hash keeps other documents out before the join.
    rows = (
        docs.select("doc_id", "text").filter((chance < max(part(0), part(1))) & (F.octet_length("text") <= longest)).join(F.broadcast(known), "doc_id")
        .select("y", "text", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).alias("build")).toPandas()
    )
    rows = rows.sort_values(["y", "text"], kind="stable")
    build, rest = rows[rows["build"]], rows[~rows["build"]]
    good, bad = (dictionary(list(build["text"][build["y"] == y])) for y in (1, 0))
    total = counts.get(1, 0) + counts.get(0, 0)
    y = rest["y"].to_numpy(np.float64)
    if not good or not bad or len(y) == 0 or y.min() == y.max():
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    measure = Measure(good, bad)
    x = np.array([measure(t) for t in rest["text"]])
    scale = x.std() + 1e-9
    w, b = fit_dense((x / scale)[:, None], y, ridge=1e-5)
    # Both labels were sampled by their own rates; the bias goes back to the rates of all labels.
    b += float(np.log(counts[1] / max(1.0, y.sum())) - np.log(counts[0] / max(1.0, (1 - y).sum())))
    return Model(good, bad, float(w[0] / scale), b)


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, parts: int = 5, held: int = 0, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``, by a model fitted on ``labels (doc_id, quality)``.

    Each whole text is compressed with the dictionary of good and with that of bad texts; the difference of the sizes,
    over the text's bytes, is all that is known of it, and becomes a probability that the label is 1.

    A null text is scored as an empty one. Rows that share an id are each scored; a label counts for all of them, the
    higher one where labels differ. Null labels, and labels all alike, leave a constant score. A null id is not held
    out. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, parts=parts, held=held, **training))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.value.scores(batch["text"])})

    out = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
