"""Corpus pipeline: documents through five stages, each stage's result a table.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
its decisions applied; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm import decontaminate, jaccard_forest, line_templates, queries, string_kernel
from dyadic.llm.common import read, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine predicts to be toxic go."""
    return string_kernel.drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for one document that keeps them; n_chars follows the text."""
    out = line_templates.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the largest id stays."""
    return jaccard_forest.keep_one_per_group(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which to take them; those with rate 0 go."""
    return queries.mixed(docs, read(spark, sf_dir, "labels")).where("rate > 0")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]

#: SQL has no twin of the trained stages; tests/llm checks the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
