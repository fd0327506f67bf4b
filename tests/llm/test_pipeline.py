"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import os

import pytest

import corpus_pipeline
from quern.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    from test_methods import brute

    docs, tmp, seen = spark.read.parquet(f"{DATA}/documents.parquet"), Scratch(spark, "test"), {}
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        docs = tmp.save(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "tokens"
        before = docs
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {d for d, _ in rows(seen["quality"][1])}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    a, b = rows(seen["exact"][0]), rows(seen["exact"][1])
    low = {}
    for d, t in a:
        k = t.encode().lower()
        low[k] = max(low.get(k, -1), d)
    assert sorted(d for d, _ in b) == sorted(low.values())
    a, b = rows(seen["near"][0]), rows(seen["near"][1])
    assert sorted(d for d, _ in b) == sorted({c for _, c in brute(a, 5, 80).values()})
    out = seen["tokens"][1].collect()
    assert len(out) == seen["mix"][1].count() and all(r["round_trip"] for r in out)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
