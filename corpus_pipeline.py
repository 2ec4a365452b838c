"""Corpus pipeline: quality filter, exact and near duplicates, benchmark decontamination, packing.

Each stage takes what the stage before kept, written as Parquet and read again. All but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences. Nulls, empty texts, ties, repeated rows, empty
tables and extra columns are handled as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, exact, packing, quality, simhash
from flowloom.llm.common import documents, stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this input, does not reject."""
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question of the benchmark, copied or re-parameterised."""
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences into which all documents left are packed."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("packing", packed)]

#: The first, third and fifth stage have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
