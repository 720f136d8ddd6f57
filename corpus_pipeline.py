"""Corpus pipeline: language, lines, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.llm import bpe, langid, line_dedup, mixing, near_dedup
from inquest.llm.common import dropped, shared_dir

#: A document goes if its language can't be told or is less sure than this.
SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model can't tell."""
    return langid.recognised(docs, langid.fit(docs, ~langid.held_out()), SURE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of other documents leave; so do documents of which no word is left."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their decoding, as digests."""
    return bpe.digests(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("bpe", tokens)]

#: Several stages have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            dropped(spark, before)
        docs = before = spark.read.parquet(f"{folder}/{name}")
    return docs
