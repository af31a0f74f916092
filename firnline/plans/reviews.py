"""Outlier review lists, from files to the combined and the alternate table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators import reviews, rules
from firnline.sources import tables


def read_lists(spark: SparkSession, source: str, patterns: dict[str, str],
               names: dict[str, str] | None = None) -> DataFrame:
    """All files of each kind: ``patterns`` maps TYPE to a file name pattern.

    ``names`` maps a reviewer to a pattern of the file name and adds a name column.
    """
    from firnline.functions.labels import reviewer_tag
    parts = None
    for kind, pattern in patterns.items():
        found = tables.list_files(spark, source, pattern)
        if not found:
            continue
        raw = tables.read_review_lists(spark, found)
        if names:
            raw = raw.withColumn("name", reviewer_tag(F.regexp_extract("_path", "([^/]+)$", 1), names))
        part = reviews.typed(unify_case(raw)).drop("_path").withColumn("TYPE", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    if parts is None:
        raise FileNotFoundError(f"no review list in {source}")
    return parts


def unify_case(df: DataFrame) -> DataFrame:
    """The mark is spelt OUTLIER or Outlier; both end up as OUTLIER."""
    return df.withColumnsRenamed({c: c.upper() for c in df.columns if c.upper() == "OUTLIER"})


def combined_outliers(lists: DataFrame, year: int = reviews.ODD_YEAR) -> DataFrame:
    return reviews.combine_lists(reviews.reconcile_outlier(lists), year)


def alternate_outliers(named: DataFrame, checks: DataFrame, obs: DataFrame, reviewer: str,
                       year: int = reviews.ODD_YEAR) -> DataFrame:
    """The reviewer's list: new checks without flagged observations, over the older list."""
    fresh = reviews.strongest(rules.drop_element_year(
        reviews.without_flagged(checks, obs), reviews.ODD_ELEMENT, year))
    return reviews.alternate_list(named, fresh, reviewer).withColumn("YEAR", F.year("DATE"))
