"""The pipeline: each stage against brute force or the operator's own rule, on the smallest tables."""

import os
import re
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as p

    from assayline.llm import mixing, quality, tokens
    from tests.llm.test_neardup import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in p.STAGES:
        rows = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = p.stored(stage(spark, kept, DATA), "test-stage")
        left = {r["doc_id"] for r in out.collect()}
        assert left <= set(rows)
        if name.startswith("quality"):
            model = quality.fit(kept, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert left == {r["doc_id"] for r in quality.score(kept, model).collect() if r["quality_score"] >= 0.5}
        if name.startswith("MinHash"):
            assert left == {i for i, (_, c) in brute(rows.items(), 5).items() if i == c}
        if name.startswith("benchmark"):
            squeeze = lambda t: re.sub(r"\s+", " ", t.lower())
            items = [squeeze(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not left & {i for i, t in rows.items() if any(b in squeeze(t) for b in items)} and len(left) >= len(rows) * 0.9
        if name.startswith("mixing"):
            assert left == {r["doc_id"] for r in mixing.weigh(kept).collect() if r["mix_kept"]}
        if name.startswith("token"):
            e = tokens.ChunkEncoder(tokens.TokenConfig())
            start = 0
            for r in out.orderBy("doc_id").collect():
                n = len(e.tokenizer.encode(rows[r["doc_id"]], add_special_tokens=False).ids) + 1
                assert (r["start"], r["n_tokens"]) == (start, n)
                start += n
            assert left == set(rows)
        else:
            assert out.columns == columns
        kept = out
    assert p.run(spark, DATA).count() == kept.count()


def test_stages_on_odd_rows(spark):
    """Null ids, texts, sources and languages, empty and very long texts, repeated rows and clashing columns; empty tables."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    schema = docs.schema
    first = docs.first()
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "a", 0), (None, "some words without an id, twice", "en", "a", 5), (None, "some words without an id, twice", "en", "a", 5), (10**6 + 2, "word " * 200_000, None, "b", 10**6), tuple(first), tuple(first)]
    held = docs.union(spark.createDataFrame(odd, schema))
    for clash in ("mix_kept", "quality_score", "component_id", "text_key", "rank", "shard"):
        held = held.withColumn(clash, F.lit("x"))
    for name, stage in p.STAGES:
        before = held.count()
        out = p.stored(stage(spark, held, DATA), "odd-stage")
        assert stage(spark, held.limit(0), DATA).count() == 0
        if name.startswith("token"):
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == before
            assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]
        else:
            assert out.columns == held.columns and 0 < out.count() <= before
            if name.startswith("MinHash"):
                ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
                assert len(ids) == len(set(ids)) and out.where("doc_id is null").count() == held.where("doc_id is null").count()
            held = out


def test_workers_give_memory_back():
    """Blocks freed below one that lives on go back to the system when a task ends."""
    code = """
import os, numpy as np
from assayline.llm.shared import give_back
now = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
held = [np.ones(8000) for _ in range(3000)]  # 64 kB each
last = np.ones(8000)
full = now()
del held
give_back()
print(full - now())
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert int(got.stdout) > 100
