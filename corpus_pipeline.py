"""The corpus pipeline: each stage's result is written as Parquet and read again as the next stage's documents.

Stages keep the columns of ``documents``; the last adds the epoch and the leaf of the mixture.  Written stages lie in
the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, near_dup, quality_fm
from tessera.llm._shared import Scratch
from tessera.llm.catalog import mixed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects (score below its threshold) go."""
    return quality_fm.accept(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the row with the smallest id stays."""
    return exact_dedup.drop_rows(docs, near_dup.link(docs, percent=80))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the token budget, by seeded epochs."""
    return mixed(spark, docs).drop("domain")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("clean", clean), ("mixture", mixture)]

#: The classifier and the components of near copies are beyond SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
