"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, the last one the packed pieces. The tables labels and
benchmark are read from the folder of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, packing, quality, simhash, substring
from cuesheet.llm.common import read, save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, two bits of SimHash or a Jaccard similarity of 0.8."""
    return simhash.near_representatives(docs, size=5)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an older document holds."""
    return substring.clean(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a question of the benchmark, be it with other numbers, names or units."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality), ("simhash_near_dedup", no_near_duplicates), ("substring_dedup", no_repeated_passages),
    ("benchmark_decontamination", no_benchmark), ("best_fit_packing", packed),
]
#: SQL expresses neither the classifier nor the fingerprints; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
