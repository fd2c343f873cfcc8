"""Token ids in a compressed store that gives back single documents.

A store is a folder of two tables and a dictionary, all written by Spark's own writers, so that any store Spark can
reach will do:

``blocks``      one row per block: ``shard``, ``block``, ``dictionary`` (crc32 of the dictionary, 8 hex digits) and
                ``payload``, the zstandard frames of up to ``BLOCK_DOCS`` documents or about ``BLOCK_BYTES`` bytes, end
                to end; a longer document has a block of its own.
``index``       one row per document: ``doc_id``, ``shard``, ``block``, ``at`` and ``length`` of its frame in the payload,
                ``n_tokens``, and ``ahead``, the ids of the shard before it. Shards and, in them, documents ascend.
``dictionary``  one row: ``hash`` and ``data``, trained on serialized ids; ``width``, the bytes of one id.

A frame holds the ids of one document as little-endian unsigned integers of 2 bytes, or of 4 where the vocabulary
needs them. Reading a document takes its index row, one block and the dictionary; no other frame is decompressed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import passing, shared_dir, small_batches

BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
_DICTIONARY = 64 << 10
_tokenizers: dict[str, object] = {}
_encoders: dict[tuple, Encoder] = {}


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer(path: str):
    """One per process, on the thread that calls it, as the library loads it."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Letters of plain Latin text: all of U+00C0 to U+024F but the two signs among them.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Encoder(dict):
    """Ids of whole texts by the tokenizer at ``path``, with the end id behind each, serialized.

    The tokenizer cuts a text into pieces before it merges bytes, and merges never cross pieces, so a piece has the
    same ids wherever it stands. Pieces of plain Latin text are therefore encoded by the library's model once and then
    looked up here. A text with any other character, one that holds an added token, special or not, and any text of a
    tokenizer that cuts in another way, truncates or pads, goes to the library whole.
    """

    _OTHER = re.compile(r"[^\t\n\r -~\xc0-\u024f]")
    _PIECE = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
    _LETTERS = _byte_letters()
    _MOST = 1_000_000  # pieces kept, about 200 MB

    def __init__(self, path: str, end: int, width: int):
        super().__init__()
        self.coder, self.code = tokenizer(path), {2: "H", 4: "I"}[width]
        self.end = array(self.code, [end]).tobytes()
        cutter = self.coder.pre_tokenizer
        state = json.loads(cutter.__getstate__()) if cutter is not None else {}
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values() if t.content]
        self.by_piece = (
            self.coder.normalizer is None and self.coder.post_processor is None and self.coder.truncation is None and self.coder.padding is None
            and state.get("type") == "ByteLevel" and state.get("use_regex", True) and not state.get("add_prefix_space", True)
        )

        probes = (" the", "Éa", "\n\n", "'s", " x" * 9, "ßñ", "123", " !?", "\t")
        self.by_piece = self.by_piece and all(self._piece(p) == self._library(p) for p in probes if len(self._PIECE.findall(p)) == 1)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1").translate(self._LETTERS)
        return array(self.code, [t.id for t in self.coder.model.tokenize(letters)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.coder.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self._piece(piece)
        if len(piece) <= 64:
            if len(self) >= self._MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_piece or self._OTHER.search(text) or any(t in text for t in self.added):
            return self._library(text) + self.end
        return b"".join(map(self.__getitem__, self._PIECE.findall(text))) + self.end


def encoder(path: str, end: int, width: int) -> Encoder:
    """One per process, so that what it has looked up serves all tasks there."""
    if (path, end, width) not in _encoders:
        _encoders[path, end, width] = Encoder(path, end, width)
    return _encoders[path, end, width]


def train_dictionary(docs: DataFrame, path: str, end: int, width: int, sample: int = 1000, longest: int = 64 << 10) -> bytes:
    """Trained on about ``sample`` documents of at most ``longest`` bytes, chosen by a hash of the id.

    The dictionary changes how small the store gets, never what it holds.
    """
    n = docs.count()
    part = min(1_000_000, sample * 1_000_000 // max(1, n) + 1)
    rows = (
        docs.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part) & (F.octet_length("text") <= longest))
        .select("text").toPandas()
    )
    ids = [encoder(path, end, width).encode(t) for t in sorted(rows["text"])]
    try:
        return zstandard.train_dictionary(_DICTIONARY, ids).as_bytes()
    except zstandard.ZstdError:  # too little text; it serves as it is
        return b"".join(ids)[:_DICTIONARY]


def _known(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _pack(path: str, end: int, width: int, dictionary):
    """Frames of the documents of a partition, in order; the ids of each are counted up within the partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        known = _known(dictionary.value)
        if known:
            known.precompute_compress(level=3)
        coder = zstandard.ZstdCompressor(level=3, dict_data=known)
        name = f"{zlib.crc32(dictionary.value):08x}"
        held: list[tuple] = []
        size = block = ahead = 0

        def flush() -> pd.DataFrame:
            at = np.cumsum([0, *(len(f) for _, f, _, _ in held)])
            return pd.DataFrame({
                "shard": shard, "block": block, "dictionary": name, "payload": [b"".join(f for _, f, _, _ in held)],
                "entries": [[{"doc_id": i, "at": int(a), "length": len(f), "n_tokens": n, "ahead": b} for (i, f, n, b), a in zip(held, at, strict=False)]],
            })

        encode = encoder(path, end, width).encode
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text)
                frame = coder.compress(ids)
                if held and (len(held) >= BLOCK_DOCS or size + len(frame) > BLOCK_BYTES):
                    yield flush()
                    held, size, block = [], 0, block + 1
                held.append((None if pd.isna(i) else int(i), frame, len(ids) // width, ahead))
                size, ahead = size + len(frame), ahead + len(ids) // width
        if held:
            yield flush()

    return pack


_PACKED = (
    "shard int, block int, dictionary string, payload binary, "
    "entries array<struct<doc_id: long, at: long, length: long, n_tokens: long, ahead: long>>"
)


def write(docs: DataFrame, at: str, path: str, *, end: int = 0, partitions: int | None = None) -> None:
    """Encode every whole text of ``docs (doc_id, text)`` and write a store in ascending order of ids to ``at``.

    A null text is an empty one, which is the end id alone. A null id comes first. Rows that share an id stay next to
    each other, in the order of their texts' hashes. They may lie in several shards, so that an id, or null, that very
    many rows share is no single task. An empty table gives an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    width = 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end < 1 << 16 else 4
    data = train_dictionary(docs, path, end, width)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.pmod(F.monotonically_increasing_id(), F.lit(997)).alias("_turn"))
        .repartitionByRange(n, "doc_id", "_hash", "_turn").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
        .mapInPandas(_pack(path, end, width, spark.sparkContext.broadcast(data)), _PACKED)
    )
    packed.write.parquet(f"{at}/blocks")
    blocks = spark.read.schema(_PACKED).parquet(f"{at}/blocks")
    blocks.select("shard", "block", F.explode("entries").alias("e")).select(
        "e.doc_id", "shard", "block", "e.at", "e.length", "e.n_tokens", "e.ahead"
    ).write.parquet(f"{at}/index")
    spark.createDataFrame([(f"{zlib.crc32(data):08x}", bytearray(data), width)], "hash string, data binary, width int").write.parquet(f"{at}/dictionary")


class Store:
    """A store that ``write`` made, opened by its folder."""

    def __init__(self, spark: SparkSession, at: str):
        self.blocks = spark.read.schema(_PACKED).parquet(f"{at}/blocks")
        self.index = spark.read.parquet(f"{at}/index")
        row = spark.read.parquet(f"{at}/dictionary").first()
        self.hash, self.data, self.width = row["hash"], bytes(row["data"]), row["width"]
        self._spark = spark

    def starts(self) -> DataFrame:
        """The index with ``start``, the ids of all documents before each."""
        shards = self.index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
        base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
        return self.index.join(base, "shard").withColumn("start", F.col("_base") + F.col("ahead")).drop("_base")

    def _ids(self, frames, sizes) -> Iterator[np.ndarray]:
        return _decode(self.data, self.width, frames, sizes)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id, each from its own frame."""
        out = []
        for e in self.index.filter(F.col("doc_id") == doc_id).sort("shard", "block", "at").collect():
            here = self.blocks.filter((F.col("shard") == e["shard"]) & (F.col("block") == e["block"]))
            row = here.select("dictionary", F.expr(f"substring(payload, {e['at'] + 1}, {e['length']})").alias("f")).first()
            self.check(row["dictionary"])
            out += self._ids([row["f"]], [e["n_tokens"]])
        return out

    def check(self, name: str) -> None:
        if name != self.hash:
            raise ValueError(f"block was written with dictionary {name}, not {self.hash}")

    def checksums(self) -> DataFrame:
        """``(doc_id, start, n_tokens, ids_crc32)``, decompressed from the blocks; the ids as 32-bit integers."""
        data, width, own = self._spark.sparkContext.broadcast(self.data), self.width, self.hash

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, shard, payload, entries in zip(batch["dictionary"], batch["shard"], batch["payload"], batch["entries"], strict=True):
                    if name != own:
                        raise ValueError(f"block was written with dictionary {name}, not {own}")
                    frames = [payload[e["at"] : e["at"] + e["length"]] for e in entries]
                    ids = _decode(data.value, width, frames, [e["n_tokens"] for e in entries])
                    yield pd.DataFrame({
                        "doc_id": pd.array([e["doc_id"] for e in entries], "Int64"), "shard": shard,
                        "ahead": [e["ahead"] for e in entries],
                        "crc": [(len(x), zlib.crc32(x.astype("<u4").tobytes())) for x in ids],
                    }).assign(n_tokens=lambda d: d["crc"].str[0], ids_crc32=lambda d: d["crc"].str[1]).drop(columns="crc")

        rows = self.blocks.mapInPandas(read, "doc_id long, shard int, ahead long, n_tokens long, ids_crc32 long")
        shards = self.index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
        base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
        return rows.join(base, "shard").select("doc_id", (F.col("_base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def _decode(data: bytes, width: int, frames, sizes) -> Iterator[np.ndarray]:
    coder = zstandard.ZstdDecompressor(dict_data=_known(data))
    for frame, n in zip(frames, sizes, strict=True):
        ids = np.frombuffer(coder.decompress(bytes(frame)), f"<u{width}")
        if len(ids) != n:
            raise ValueError("a frame holds another number of ids than its index entry")
        yield ids


def round_trip(docs: DataFrame, path: str, *, end: int = 0) -> DataFrame:
    """Write a store of ``docs`` into the shared folder and read the digest of every document back from its files.

    The store goes with the other intermediate tables when the process ends; ``write`` makes one that stays."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    passing(spark, at)
    write(docs, at, path, end=end)
    return Store(spark, at).checksums()
