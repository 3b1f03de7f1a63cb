"""Corpus pipeline: stages over documents, each written and read again as the next one's input.

Documents that the quality classifier rejects go; of equal texts one stays; of each group of
near duplicates (five-word shingles, Jaccard 0.8 or more) one stays; documents with a benchmark
passage go; the rest is mixed to the sources' target weights, and the last stage returns how
often each document is emitted.

Every stage takes the documents columns and any others, whatever their names. A null text counts as
empty. Rows are judged by their text: one with a null or repeated id is a row like any other, except
that equal rows have equal fates until a stage that keeps one of them. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haystrata.llm import decontaminate, exact_dedup, jaccard, mixing, quality
from haystrata.llm.scratch import free, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row stays if its text's score reaches the threshold; empty texts get what the model gives for no words."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts (A-Z lower-cased; empty ones too) exactly one row stays, with the largest id, null below all."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group linked by five-word shingles at 0.8 the row with the smallest id stays; empty texts link with nothing;
    rows with null or repeated ids are told apart by their texts."""
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: a row goes if its text holds a benchmark phrase; empty texts and items hold none."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the mix takes, with their number of copies; a text without words is not taken."""
    return mixing.mix(docs).filter(F.col("copies") > 0)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]
#: A trained classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
