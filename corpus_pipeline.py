"""Documents from language to packed sequences: each stage applies one operator to all that the stage before it kept.

Stages take (spark, docs, sf_dir). All but the last return documents' columns; the last one returns pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorfold.llm import decontaminate, language, minhash, packing, suffix_dedup
from tensorfold.llm.frames import discard, scratch, written

#: Hundredths of similarity from which documents are copies of one another.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, NEAR)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filtered(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language", language_id), ("near duplicates", near_dedup), ("repeated passages", passage_dedup), ("benchmark passages", decontamination), ("packing", pack)]

#: SQL can't express any of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:  # what a stage wrote on its way goes once its result is written
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.add(docs.written_path)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
