"""The corpus pipeline: five stages over `documents`, each over all that its predecessor kept.

1. toxicity: documents that the factorization machine scores 0.7 or more go.
2. line dedup: of each component of near-duplicate lines one line stays.
3. SimHash near-dedup: one document of each group stays.
4. benchmark decontamination: documents with a window that matches an item go.
5. byte-level BPE: ids of what is left, counted and digested, and decoded again.

Stages 1 to 4 return the columns of documents; each is written as Parquet to the
shared folder and read again, so an executor lost later repeats nothing before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkshelf.llm import _common, bpe, decontaminate, line_dedup, simhash_dedup, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontamination),
    ("byte_bpe", _encoding),
]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
