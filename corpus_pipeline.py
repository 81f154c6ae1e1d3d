"""The corpus pipeline: documents to packed training sequences, five stages of the text-preparation operators."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from takt.llm import mixing, packing, quality_rules, secret_scan, simhash
from takt.sources.runs import shared_folder


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.mask_secrets(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them; at most two of a source are cut."""
    return mixing.mix(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", stage_quality), ("simhash_dedup", stage_near_duplicates), ("secret_scan", stage_secrets), ("mixing", stage_mix),
          ("packing", stage_pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
