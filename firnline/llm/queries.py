"""The corpus operators as named queries over the whole tables, each with check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firnline.llm import checks
from firnline.llm.crosstoken import alignment
from firnline.llm.decontam import contamination
from firnline.llm.html import extract
from firnline.llm.langid import identify
from firnline.llm.mixing import mixed_ids
from firnline.llm.piecewise import edited_likeness
from firnline.llm.quality import quality
from firnline.llm.sharding import placement
from firnline.llm.simhash import near_duplicates
from firnline.llm.substrings import digest, without_repeats
from firnline.llm.text import table
from firnline.llm.urls import judged
from firnline.llm.warc import round_trip
from firnline.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


@query("op1_quality_ratio", checks.QUALITY)
def op1(spark: SparkSession, root: str) -> DataFrame:
    return quality(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op2_golay_simhash")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


@query("op3_poisson_mix", checks.MIX)
def op3(spark: SparkSession, root: str) -> DataFrame:
    return mixed_ids(table(spark, root, "documents"))


@query("op4_count_min", checks.REPEATS)
def op4(spark: SparkSession, root: str) -> DataFrame:
    return digest(without_repeats(table(spark, root, "documents")))


@query("op5_hilbert_shards", checks.SHARDS)
def op5(spark: SparkSession, root: str) -> DataFrame:
    return placement(table(spark, root, "documents"))


@query("op6_piece_language")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return identify(table(spark, root, "documents"))


@query("op7_winnowing", checks.CONTAMINATION)
def op7(spark: SparkSession, root: str) -> DataFrame:
    return contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op8_warc_split", checks.WARC)
def op8(spark: SparkSession, root: str) -> DataFrame:
    return round_trip(table(spark, root, "pages"))


@query("op9_block_tree")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return extract(table(spark, root, "pages"))


@query("op10_url_ratio", checks.URLS)
def op10(spark: SparkSession, root: str) -> DataFrame:
    return judged(table(spark, root, "pages"))


@query("op11_refined_whitening")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return whitened(table(spark, root, "embeddings"))


@query("op12_piecewise_hash")
def op12(spark: SparkSession, root: str) -> DataFrame:
    return edited_likeness(table(spark, root, "documents"))


@query("op13_pair_bitmaps")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return alignment(table(spark, root, "documents"))
