"""A training corpus from raw documents: five stages, each written and read again by the next.

Toxic documents go; of each group of near copies the document with the smallest id stays; byte
passages that an earlier document holds are removed; benchmark passages are removed; what is left
is packed into token sequences. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagrid.llm import decontam, jaccard_join, packing, suffix_dedup, toxicity
from sylvagrid.llm.common import table
from sylvagrid.session import scratch_path

SHINGLE = 5
PERCENT = 80


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_firsts(docs, SHINGLE, PERCENT)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.dedup(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_encoder())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats),
    ("benchmark", drop_benchmark), ("packing", pack)]

ORACLE_SQL = None  # a fitted scorer and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole pipeline."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
