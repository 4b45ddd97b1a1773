"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

Every stage but the last returns the columns of `documents`. Each result is written as Parquet and read again, which also
cuts the lineage, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, linededup, packing, simhash, toxicity
from lodestone.llm.common import drop_folder, new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, calls toxic go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut from the texts; all documents stay."""
    return linededup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints the document with the smallest id stays; then of each group that is near by its
    shingles, which fingerprints may have missed."""
    return simhash.keep_one(simhash.keep_near(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of `benchmark` within the edit budget go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL can't express the classifier, the fingerprints, the alignment or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again, and removed once the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        where = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(f"{where}/docs")
        docs = spark.read.parquet(f"{where}/docs")
        if before:
            drop_folder(before)
        before = where
    return docs
