from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from parlance.llm import decontaminate, token_store


def test_stages(spark, tmp_path):
    def text(k: int) -> str:
        r = random.Random(k)
        return " ".join(f"w{'abcdefghijklmnopqrst'[r.randrange(20)]}{'abcdefghijklmnopqrst'[r.randrange(20)]}" for _ in range(60))

    item = " ".join(f"bench{k}" for k in range(20))
    rows = []
    for k in range(120):
        t = text(k)
        if k % 10 == 0:
            t += " rottenword"
        if k % 10 == 1 and k > 1:
            t = text(1)
        if k % 10 == 2:
            t += " " + item
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
            now = {x["doc_id"] for x in docs.collect()}
        if k == 0:
            assert now == {i for i in left if i % 10}
        if k == 1:
            assert {i for i in now if i % 10 == 1} == {1} and {i for i in now if i % 10 > 1} == {i for i in left if i % 10 > 1}
        if k == 2:
            assert now == {i for i in left if i % 10 > 2} | {1}
            assert all(not list(decontaminate.hits_in(left[i], *decontaminate._automaton([(1, item)], 0.2))) for i in now)
        if k == 3:
            counts = {x["doc_id"]: x["count"] for x in docs.groupBy("doc_id").count().collect()}
            assert max(counts.values()) == 2
            total = docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
            assert abs(total - 1.5 * 60 * 85) < 120
    got = docs.orderBy("start").collect()
    assert [x["doc_id"] for x in got] == sorted(i for i, n in counts.items() for _ in range(n))
    coder, start = Tokenizer.from_file(token_store.public_vocabulary()), 0
    for x in got:
        ids = [*coder.encode(left[x["doc_id"]], add_special_tokens=False).ids, 0]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert corpus_pipeline.run(spark, d).count() == len(got)


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
