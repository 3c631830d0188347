"""The ten operators as queries over the tables of a folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bpe, contamination, embeddings, licenses, near_dup, pii, quality, secrets, token_counts, urls
from pathloom.llm.common import table


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_ownership(table(spark, sf_dir, "documents"))


def op2_minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents"))


def op3_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.selected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_templates(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_counts(table(spark, sf_dir, "documents"))


def op7_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op8_contamination_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op10_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_classes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_ownership, op2_minhash_pairs, op3_license_spans, op4_ordinal_quality, op5_url_templates, op6_prefix_token_counts, op7_bpe_encode, op8_contamination_spans, op9_pii_sanitised, op10_embedding_pairs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ownership": secrets.SQL, "op5_url_templates": urls.SQL}
