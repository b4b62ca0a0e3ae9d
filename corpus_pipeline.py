"""The corpus pipeline: score, deduplicate, decontaminate, mix and shard documents.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``, whatever these are.
No stage can be said in SQL as a whole (trained model, signatures, greedy map), so
ORACLE_SQL is None; ``tests/llm/test_llm_pipeline.py`` checks the rows by brute force.

Nulls: a null text is scored as an empty one, is a near copy of nothing, is never
contaminated and has no words; null ids, repeated rows and empty tables go through
every stage as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dup, quality, sharding
from tidemark.llm.common import stage
from tidemark.session import ship_package
from tidemark.sources.tables import read_table

SHARDS = 40
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1."""
    ship_package(spark)
    model = quality.train(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return quality.with_scores(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies; rows that repeat
    that id all stay."""
    ship_package(spark)
    return near_dup.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    ship_package(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, text_crc32, virtual_slot and shard."""
    return sharding.shard(docs, SHARDS)[0]


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
