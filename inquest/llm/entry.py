"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inquest.llm import bpe, langid, line_dedup, lm_bloom, mixing, near_dedup, pii, quality_rules, quality_sites, vector_dedup
from inquest.llm.common import documents

_DRAWN: dict[str, str] = {}


def secret(spark: SparkSession) -> str:
    """The key of pseudonyms: the session's setting, or one drawn for this application and kept nowhere."""
    return spark.conf.get("spark.inquest.pii.key", None) or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": lambda spark, d: bpe.digests(documents(spark, d)),
    "op2_pseudonyms": lambda spark, d: pii.report(documents(spark, d), secret(spark)),
    "op3_line_dedup": lambda spark, d: line_dedup.digests(documents(spark, d)),
    "op4_quality_rules": lambda spark, d: quality_rules.verdicts(documents(spark, d)),
    "op5_vector_dedup": lambda spark, d: vector_dedup.membership(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op6_mixing": lambda spark, d: mixing.shares(documents(spark, d)),
    "op7_bagminhash": lambda spark, d: near_dedup.membership(documents(spark, d)),
    "op8_lm_bloom": lambda spark, d: lm_bloom.scores(documents(spark, d)),
    "op9_language_id": lambda spark, d: langid.predictions(documents(spark, d)),
    "op10_quality_classifier": lambda spark, d: quality_sites.verdicts(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
