"""The pipeline's rows against a brute-force version of its deciding stages."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpus import benchmark_hits, corpus, frame, near_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The awkward corpus as documents, with the given labels and benchmark."""
    out = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[20][1].split()[:20]))], "item_id long, text string").write.parquet(
        f"{out}/benchmark.parquet")
    return out


def stages(spark, folder, docs):
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        yield [tuple(r) for r in docs.collect()], docs.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)


@pytest.mark.parametrize("source", [SF, None])
def test_stages(spark, folder, source):
    at = source or folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    after = list(stages(spark, at, docs))
    assert all(columns == docs.columns for _, columns in after[:-1])
    scores = Counter((r.doc_id, r.text) for r in quality.with_scores(docs, model).filter("score >= 0.3").collect())
    assert Counter((r[0], r[1]) for r in after[0][0]) == scores
    groups = near_components(after[0][0])
    assert Counter(after[1][0]) == Counter(r for r, (i, _, least) in zip(after[0][0], groups) if i == least)
    hits = benchmark_hits(after[1][0], bench)
    assert Counter(after[2][0]) == Counter(
        r for r, (_, n, hit, _) in zip(after[1][0], hits) if not (hit and 20 * hit >= n))
    report = mixing.mix_report(frame(spark, after[2][0])).collect()
    assert len(after[3][0]) == sum(r.copies if r.size else 1 for r in report)
    assert set(after[3][0]) <= set(after[2][0])
    shard = after[4][1].index("shard")
    width = [after[4][1].index(c) for c in docs.columns]
    assert Counter(tuple(r[i] for i in width) for r in after[4][0]) == Counter(after[3][0])
    assert {r[shard] for r in after[4][0]} <= set(range(corpus_pipeline.SHARDS))
    assert len(before) >= len(after[0][0]) > 0


def test_empty_documents(spark, folder):
    for (_, step) in corpus_pipeline.STAGES:
        assert step(spark, frame(spark, []), folder).collect() == []


def test_clashing_columns(spark, folder):
    docs = frame(spark, corpus()[:40], clashes=True)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns
