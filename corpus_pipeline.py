"""From raw documents to a training mix: quality, near duplicates, benchmark passages, secrets, mixing.

Every stage takes all that its predecessor kept and, but for the last, returns the columns of ``documents``. Rows without a
doc_id and repeated rows are documents like others; an empty table goes through all stages and comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoloom.llm import decontaminate, mixing, quality, secrets, simhash
from isoloom.shared import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row judged by its whole text; see ``quality.keep_good``."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that with the smallest doc_id; see ``simhash.keep_one``."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts stay; see ``decontaminate.decontaminate``."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; see ``secrets.redact``."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, written as shards of word blocks, and what it takes of every document: doc_id, size, source_size, target,
    taken; see ``mixing.mix``."""
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("benchmark", no_benchmark), ("secrets", no_secrets), ("mixing", mixture)]

#: Fingerprints, token automata and drawn slots have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialise(docs, "stage") if k + 1 < len(STAGES) else docs
    return docs
