"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a table; all but the last
keep the columns of documents.  SQL can't express the first and the last stage, so the pipeline is tested against a
brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistmill.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from gistmill.llm._shared import cut, table
from gistmill.llm.queries import RANKS


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels, doesn't predict toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; those left without text go."""
    return line_dedup.apply(docs, short=True)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept documents."""
    return bpe.round_trip(docs, RANKS)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("ngram_join", stage_ngram_join),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
