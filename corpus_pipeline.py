"""From raw documents to token ids: toxic and nearly equal documents and benchmark passages go, sources are mixed.

All stages keep every column of their input, whatever its name, and give an empty table for an empty one. Rows that share
an id go or stay together; rows with a null id stay in the filtering stages. A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, minhash, mixing, token_store, toxicity
from parlance.llm.shared import cut, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeat or go so that each source comes near its target."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of every document read back from the token store; a repeated document has a row for each time."""
    return token_store.round_trip(docs, token_store.public_vocabulary(), end=0)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: The trained scores, the signatures and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
