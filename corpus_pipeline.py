"""A corpus from language identification to shards, stage by stage, each written as Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.llm.decontam import uncontaminated_rows
from firnline.llm.langid import identified
from firnline.llm.mixing import mixed
from firnline.llm.sharding import shards
from firnline.llm.simhash import keep_first
from firnline.llm.text import table
from firnline.session import bound_batches, cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be identified."""
    bound_batches(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (SimHash of 3-word shingles, 2 bits), that with the smallest id."""
    bound_batches(spark)
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shares no window with the benchmark."""
    bound_batches(spark)
    return uncontaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's weight, shuffled."""
    return mixed(docs).drop("n_copies", "copy", "position")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of them with their shard and slot."""
    return shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

# SQL has no counterpart for the language model and the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
