"""Line deduplication by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_spread

#: A line ends behind line breaks, or behind the space that follows the end of a sentence; white space alone is no line.
LINE_END = r"(?<=\n|[.!?] )(?![ \t\r]*(?:\n|\z))"
_MARK = "\x01"


def lines_of(text: Column, plain: bool = False) -> Column:
    """Joined without a separator, the lines are the text again; ``plain``: with spaces for line breaks.

    Marks are set by plain replacement, which is several times faster than the pattern; texts that hold the mark
    themselves, or white space behind one, are cut by the pattern.
    """
    text = F.coalesce(text, F.lit(""))
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    marked = F.rtrim(F.replace(marked, F.lit(_MARK + "\n"), F.lit("\n")), F.lit(_MARK))
    rare = F.split(text, LINE_END, -1)
    rare = F.transform(rare, lambda x: F.replace(x, F.lit("\n"), F.lit(" "))) if plain else rare

    def cut_at_marks(m: Column) -> Column:
        odd = F.contains(text, F.lit(_MARK))
        for space in " \t\r":
            odd = odd | F.contains(m, F.lit(_MARK + space))
        return F.when(odd, rare).otherwise(F.split(F.replace(m, F.lit("\n"), F.lit(" ")) if plain else m, _MARK, -1))

    return F.transform(F.array(marked), cut_at_marks)[0]  # marks are set once


def _words(line: Column) -> Column:
    """Words by the spaces between them, but one for every 12 bytes, as not all scripts have spaces, and one at least."""
    spaced = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1
    return F.greatest(spaced, F.octet_length(line) / 12).cast("int")


def _unit(i: Column, min_words: int) -> Column:
    """The lines from ``i`` on up to where they have enough words: their hash ``h`` and number ``l``; null where the
    document ends before. They are ``min_words`` lines at most, as each has a word. Written out, as most have one or two."""
    out, words = F.lit(False), F.get("_n", i)
    for k in range(1, min_words + 1):
        unit = F.struct(F.xxhash64(*[F.get("_h", i + j) for j in range(k)]).alias("h"), F.lit(k).alias("l"))
        out = F.when(words >= min_words, unit) if k == 1 else out.when(words >= min_words, unit)
        words = words + F.get("_n", i + k)
    return out


def _chosen(u: Column, i: Column, window: int) -> Column:
    """No unit hash is less in one of the windows that hold unit ``i`` and lie within the document."""
    size, least = F.size("_u"), F.lit(False)
    no_less = {k: F.get("_u", i + k)["h"].isNull() | (F.get("_u", i + k)["h"] >= u["h"]) for k in range(1 - window, window) if k}
    for s in range(1 - window, 1):
        here = (i + s >= 0) & (i + s + window <= size) if s else (i + window <= size) | (size < window)
        for k in range(s, s + window):
            here = here & no_less[k] if k else here
        least = least | here
    return least


def _whole(i: Column, back: Column, m: Column, window: int) -> Column:
    """The hash of all lines a copy may share around unit ``i``: from ``back`` lines before it to ``m`` on."""
    near = [F.when(back >= -k, F.get("_h", i + k)) if k < 0 else F.when(m > k, F.get("_h", i + k)) for k in range(1 - window, 2 * window)]
    far = F.xxhash64(F.transform(F.sequence(i - back, i + m - 1), lambda k: F.get("_h", k)))
    return F.when(m <= 2 * window, F.xxhash64(back, m, *near)).otherwise(far)


def _stretches(window: int) -> Column:
    """For each place of ``_at``, the runs of lines to its right or left that a copy may share: ``(key, a, b)`` by content."""

    def of(x: Column) -> Column:
        i, end = x["i"], x["i"] + x["l"]
        run = lambda a, b: F.struct(F.xxhash64(F.transform(F.sequence(a, b - 1), lambda k: F.get("_h", k))).alias("key"), a.alias("a"), b.alias("b"))
        right = F.transform(F.sequence(end, F.greatest(end, i + x["m"])), lambda b: run(i, b))
        left = F.transform(F.filter(F.sequence(F.greatest(i - window + 1, F.lit(0)), i), lambda a: a < i), lambda a: run(a, end))
        return F.concat(right, left)

    return F.flatten(F.transform("_at", of))


def repeated_lines(docs: DataFrame, window: int = 3, min_words: int = 8, alone: int = 20) -> DataFrame:
    """``(doc_id, text_hash, runs)``: the runs ``(a, b)`` of line positions, from 0, to delete from the documents that have any.

    A unit is the run of lines from one line on, up to where it has ``min_words`` words. Fingerprints are the least unit
    hash of each ``window`` neighbouring units, and lines of ``alone`` words. So every repeated run of ``window`` units
    has a fingerprint in all its copies, and so has every one of ``(window - 1) * (alone - 1) + min_words`` words.

    Places with a common fingerprint are joined, and matches extended both ways while lines stay equal. The fingerprints
    that copies share follow each other by ``window`` lines at most, the first one is less than ``window`` lines behind
    the start of what is equal, and the last one has less than another unit behind it; so none need be extended further
    than that. Where all of these lines are the same as at an earlier place, they go, and the earliest such place stands
    for the others from there on. What is left is extended line by line: each length is posted under the hash of its
    lines and compared with the first place that has it. So the longest run that any earlier place shares is found, not
    only what the first holder of a fingerprint shares. Groups of any size are aggregated before they are shuffled, and
    joined with one row.

    What precedes a run in the order of (doc_id, hash of the text, position) stays, so the first copy of every line
    always stays. Lines are compared without spaces and line breaks at their ends.
    """
    trimmed = F.transform(lines_of(F.col("text"), plain=True), lambda x: F.trim(x))
    back = lambda i: F.least(i, F.lit(window - 1))
    # The lines from a place on that a copy may share, up to where the unit ``window`` lines on would end.
    reach = lambda i: F.when(F.get("_u", i + window).isNotNull(), window + F.get("_u", i + window)["l"] - 1).otherwise(F.size("_h") - i)
    mark = lambda x, i, m: F.struct(x["h"].alias("u"), _whole(i, back(i), m, window).alias("k"), i.alias("i"), x["l"].cast("byte").alias("l"), m.cast("byte").alias("m"))
    with_reach = lambda x, i: F.transform(F.array(F.greatest(x["l"], reach(i))), lambda m: mark(x, i, m))[0]
    table = cut(
        docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("doc_id").alias("_d"), F.hash("text").alias("_t"), trimmed.alias("_l"))
        .select("_d", "_t", F.transform("_l", lambda x: F.xxhash64(x)).alias("_h"), F.transform("_l", _words).alias("_n"))
        .select("_d", "_t", "_h", "_n", F.transform("_n", lambda n, i: _unit(i, min_words)).alias("_u"))
        .select("_d", "_t", "_h", F.filter(
            F.transform("_u", lambda x, i: F.when(x.isNotNull() & ((F.get("_n", i) >= alone) | _chosen(x, i, window)), with_reach(x, i))),
            lambda x: x.isNotNull(),
        ).alias("_marks")),
        "lines", hashes=True,
    )
    # A place is a document's id and, in one number, the hash of its text and the line.
    place = lambda i: (F.shiftleft(F.col("_t").cast("long"), 32) + i).alias("_p")
    text_hash, line = F.shiftright("_p", 32).cast("int").alias("_t"), F.col("_p").bitwiseAND(0xFFFFFFFF).cast("int")
    places = table.select("_d", "_t", F.explode("_marks").alias("x")).select("x.u", "x.k", "_d", place(F.col("x.i")), "x.l", "x.m")
    several = lambda rows, key, *more: cut(rows.groupBy(key).agg(*more, F.count("*").alias("c")).filter("c > 1"), "several")
    at = cut(join_spread(places, several(places, "u"), "u", "c", ("_d", "_p")), "places", hashes=True)
    # Where all lines are shared, the first place stands for all.
    firsts = cut(at.groupBy("k").agg(F.min(F.struct("_d", "_p")).alias("f"), F.first("u").alias("u"), F.first("l").alias("l"), F.first("m").alias("m"), F.count("*").alias("c")), "firsts", hashes=True)
    same = join_spread(at.select("k", "_d", "_p"), firsts.filter("c > 1").select("k", "f", "m", "c"), "k", "c", ("_d", "_p")).filter(F.struct("_d", "_p") > F.col("f"))
    same = same.select("_d", text_hash, (line - F.least(line, F.lit(window - 1))).alias("a"), (line + F.col("m")).alias("b"))
    # The rest by each length.
    rest = firsts.select("u", "f._d", "f._p", "l", "m")
    rest = join_spread(rest, several(rest, "u"), "u", "c", ("_d", "_p"))
    rest = rest.select("_d", text_hash, F.struct(line.alias("i"), F.col("l").cast("int").alias("l"), F.col("m").cast("int").alias("m")).alias("x"))
    by_doc = rest.groupBy("_d", "_t").agg(F.collect_list("x").alias("_at"))
    runs = cut(
        by_doc.join(table.select("_d", "_t", "_h"), ["_d", "_t"]).select("_d", "_t", F.explode(_stretches(window)).alias("x"))
        .select("x.key", "_d", place(F.col("x.a")), (F.col("x.b") - F.col("x.a")).cast("short").alias("n")),
        "runs", hashes=True,
    )
    first = several(runs, "key", F.min(F.struct("_d", "_p")).alias("f"))
    parts = join_spread(runs, first, "key", "c", ("_d", "_p")).filter(F.struct("_d", "_p") > F.col("f")).select("_d", text_hash, line.alias("a"), (line + F.col("n")).alias("b"))
    # Runs of one document that touch become one; a document's runs are no more than its lines.
    before = Window.partitionBy("_d", "_t").orderBy("a", "b")
    apart = (
        same.unionByName(parts)
        .withColumn("_new", F.coalesce(F.col("a") > F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        .withColumn("_part", F.sum(F.col("_new").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_d", "_t", "_part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    )
    return apart.select(F.col("_d").alias("doc_id"), F.col("_t").alias("text_hash"), "runs")


def dedup_lines(docs: DataFrame, window: int = 3, min_words: int = 8, alone: int = 20) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines taken out of ``text``, and ``_line_drops``, their number.

    A null text stays null, a text without words stays as it is, and so do rows with a null id. Rows that share an id are
    told apart by their texts; those that are alike stay alike. Other columns pass through. Time is in proportion to the
    length of a text, however many runs go from it.
    """
    found = repeated_lines(docs, window, min_words, alone)
    gone = found.select(F.col("doc_id").alias("_line_id"), F.col("text_hash").alias("_line_text"), F.col("runs").alias("_line_runs"))
    out = docs.join(gone, (docs["doc_id"] == gone["_line_id"]) & (F.hash(docs["text"]) == gone["_line_text"]), "left")
    # One byte per line up to the last that goes: 1 where it does.
    gap = lambda k: F.coalesce(F.get("_line_runs", k - 1)["b"], F.lit(0))
    marks = F.transform("_line_runs", lambda r, k: F.concat(F.repeat(F.lit("0"), r["a"] - gap(k)), F.repeat(F.lit("1"), r["b"] - r["a"])))
    out = out.withColumn("_line_mask", F.array_join(marks, "").cast("binary"))
    keep = F.filter(lines_of(docs["text"]), lambda x, i: F.substring("_line_mask", i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("_line_runs").isNull(), docs["text"]).otherwise(F.array_join(keep, ""))
    return out.select(
        *[text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns],
        F.coalesce(F.aggregate("_line_runs", F.lit(0), lambda s, r: s + r["b"] - r["a"]), F.lit(0)).alias("_line_drops"),
    )
