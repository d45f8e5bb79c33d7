"""Cleaning of a training corpus in five stages. Every stage works on all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumora.llm import decontamination, line_dedup, near_dedup, quality_rules
from lumora.llm.queries import bpe_digests
from lumora.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines are cut out; documents without a word left go."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the least id."""
    return near_dedup.keep_one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test items cover a twentieth or more go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of what is left."""
    return bpe_digests(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("tokens", tokens)]

#: SQL has no BPE; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
