"""A corpus pipeline of five operators; each stage works on all that the one before kept.

1. quality: documents that the ordinal classifier doesn't select go.
2. near_dup: of each group of connected near-duplicates, the document of the least id stays.
3. decontaminate: benchmark passages are cut out of the texts; a document without a word left goes.
4. secrets: live-looking credentials of a single owner are masked in the texts.
5. encode: the texts become BPE tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bpe, contamination, near_dup, quality, secrets
from pathloom.llm.common import checkpointed, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_live_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("quality", keep_good), ("near_dup", drop_near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("encode", encode)]

#: MinHash, the classifier and BPE are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
