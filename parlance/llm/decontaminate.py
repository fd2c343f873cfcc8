"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance over words."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches

#: Benchmark text searched for in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
_SPLIT = re.compile(r"[\W_]+")
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
_SPLIT_ANY = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
#: Scripts written without spaces between words; each character counts as a word, with the marks on it.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ーｰ]\p{M}*+")
_automata: dict[str, tuple] = {}


def normal(text: str | None) -> str:
    """Words in lower case, each between single spaces; punctuation and white space only divide them.

    In scripts that don't divide words by spaces, characters stand for words."""
    text = f" {(text or '').lower()} "
    if not _BEYOND_LATIN.search(text):
        return _SPLIT.sub(" ", text)
    return _SPLIT_ANY.sub(" ", _UNSPACED.sub(r" \g<0> ", text))


def budget(words: int, rate: float) -> int:
    return int(words * rate)


def pieces(words: list[str], errors: int) -> Iterator[tuple[int, str]]:
    """``errors + 1`` runs of words that cover the item, each with its place: of them one at least has no error."""
    n = errors + 1
    edges = [len(words) * k // n for k in range(n + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, f" {' '.join(words[a:b])} "


def distance(item: list[str], words: list[str]) -> tuple[int, int]:
    """The least number of edited words between ``item`` and any run in ``words``, and where such a run ends.

    One step of bit operations for each word of the text, on integers with one bit for each word of the item.
    """
    at: dict[str, int] = defaultdict(int)
    for k, w in enumerate(item):
        at[w] |= 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best = (score, 0)
    for j, w in enumerate(words, 1):
        eq = at.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # a run may start anywhere
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best[0]:
            best = (score, j)
    return best


def _automaton(items: list[tuple[int, str]], rate: float):
    index: dict[str, list[tuple[int, int]]] = defaultdict(list)
    split = {}
    for key, (item, text) in enumerate(items):
        words = normal(text).split()
        if words:
            split[key] = (item, words, budget(len(words), rate))
            for at, piece in pieces(words, split[key][2]):
                index[piece].append((key, at))
    machine = ahocorasick.Automaton()
    for piece, owners in index.items():
        machine.add_word(piece, (len(piece), owners))
    if index:
        machine.make_automaton()
    return (machine if index else None), split


def hits_in(text: str | None, machine, split: dict) -> Iterator[tuple[int, int, int]]:
    """``(item, distance, word where it ends)`` for each item with a run in the text within its error budget."""
    if machine is None or not text:
        return
    line = normal(text)
    places = defaultdict(set)
    for end, (length, owners) in machine.iter(line):
        for key, at in owners:
            places[key].add((end - length + 1, at))
    if not places:
        return
    words, starts = line.split(), [i for i, c in enumerate(line) if c == " "]
    for key, found in places.items():
        name, item, errors = split[key]
        windows = sorted(max(0, bisect_right(starts, place) - 1 - at - errors) for place, at in found)
        best, k = (errors + 1, 0), 0
        while k < len(windows):
            a = b = windows[k]
            while k < len(windows) and windows[k] <= b + len(item):  # one search where windows overlap
                b = windows[k]
                k += 1
            d, end = distance(item, words[a : b + len(item) + 2 * errors])
            best = min(best, (d, a + end))
            if d == 0:
                break
        if best[0] <= errors:
            yield name, *best


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2) -> DataFrame:
    """``(doc_id, item_id, distance, end_word)``: the documents that hold a benchmark item with few edits.

    Items and documents are compared as words, in lower case, without punctuation; in scripts without spaces, as
    characters. An item of ``n`` words may differ in ``int(n * rate)`` words put in, left out or changed, so one of fewer
    than five words must occur as it is. It is cut into that many pieces and one more, one of which must occur unchanged;
    all pieces are found in one pass over each whole text, and each place is verified.

    The benchmark is sent to the executors in blocks of ``BLOCK_BYTES`` (or one item), with a pass over the documents
    for each; its total size is summed first. With more than one block, the hits of each are written and its items freed
    before the next. Items without a letter or digit hold nothing to search for. Null texts and texts without words hold
    nothing; an empty benchmark gives an empty result. Each row of documents is taken as it is; items that share an id
    are each searched, those with equal texts too once. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    out = None
    for block in range(blocks):
        part = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).sort("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(part)
        found = docs.select("doc_id", "text").mapInPandas(_search(uuid.uuid4().hex, sent, rate), "doc_id long, item_id long, distance int, end_word long")
        if blocks > 1:
            found = cut(found, "hits")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(name: str, items, rate: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _automata:  # once per process
            _automata.clear()
            _automata[name] = _automaton(items.value, rate)
        machine, split = _automata[name]
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for hit in hits_in(t, machine, split)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end_word"])

    return search


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those that hold a benchmark item. Rows with a null id stay."""
    gone = contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
