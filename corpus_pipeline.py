"""Corpus cleaning in stages; each stage reads all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm import bpe, decontaminate, pii, simhash, toxicity
from netvigil.llm.common import fold, row_name, table
from netvigil.llm.queries import word_bpe
from netvigil.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Rows are told apart by id and text, so one without an id goes like any other."""
    scores = toxicity.score(docs, table(spark, sf_dir, "labels"), fold(4) != 2, named=True)
    rejected = materialize(scores.where(F.col("score") >= toxicity.THRESHOLD).select(F.col("row_name").alias("_row")).distinct(), "toxic")
    return docs.withColumn("_row", row_name()).join(rejected, "_row", "left_anti").drop("_row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of each document, with the digest of what they decode to."""
    return bpe.encode_digests(docs, word_bpe(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("simhash", near_duplicates), ("decontamination", decontaminated), ("pii", without_pii), ("bpe", encoded)]

# Hash fingerprints, model scores and subword ids cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
