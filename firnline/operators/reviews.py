"""Lists of reviewed outliers: combine, reconcile, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.labels import parse_mixed_date
from firnline.operators.rules import anti, distinct_keep, drop_element_year, keep_flagged

KEYS = ["ID", "DATE", "ELEMENT", "VALUE"]
# The anomalous year of water equivalents.
ODD_ELEMENT, ODD_YEAR = "WESD", 1952


def reconcile_outlier(df: DataFrame) -> DataFrame:
    """One OUTLIER column from OUTLIER and the differently spelt Outlier.

    Column names differ only in case, so the second arrives as ``Outlier_2``.
    """
    if "Outlier_2" not in df.columns:
        return df
    return df.withColumn("OUTLIER", F.coalesce("OUTLIER", "Outlier_2")).drop("Outlier_2")


def typed(df: DataFrame) -> DataFrame:
    """Review columns read as text, with their real types."""
    out = df
    for c, t in (("VALUE", "double"), ("FLAGGED", "int"), ("OUTLIER", "int")):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast(t))
    return out.withColumn("DATE", parse_mixed_date(F.col("DATE")))


def strongest(df: DataFrame, extra=()) -> DataFrame:
    """One row per observation, the one with the largest absolute OUTLIER."""
    size = F.abs("OUTLIER")
    rest = [c for c in ("OUTLIER", "TYPE", "FLAGGED", *extra) if c in df.columns]
    return distinct_keep(df, KEYS, [size.isNull(), -size, *rest])


def combine_lists(lists: DataFrame, year: int = ODD_YEAR) -> DataFrame:
    """Combined outlier table: without the odd year, one row per observation, with YEAR."""
    kept = drop_element_year(lists, ODD_ELEMENT, year)
    return strongest(kept.withColumn("YEAR", F.year("DATE")))


def yearly_counts(outliers: DataFrame) -> DataFrame:
    return (outliers.where(F.col("OUTLIER") > 0).groupBy("ID", F.year("DATE").alias("YEAR"))
            .agg(F.count(F.lit(1)).alias("n")))


def drop_known_years(lists: DataFrame, station_list: DataFrame, year: int = ODD_YEAR) -> DataFrame:
    """Remove the odd year's water equivalents of the listed stations only."""
    bad = station_list.select(F.col("ID").alias("_id")).distinct().withColumn("_listed", F.lit(True))
    marked = lists.join(bad, F.col("ID") == F.col("_id"), "left")
    odd = (F.col("_listed").isNotNull() & (F.col("ELEMENT") == ODD_ELEMENT)
           & (F.year("DATE") == year))
    return marked.where(~F.coalesce(odd, F.lit(False))).select(*lists.columns)


def without_flagged(checks: DataFrame, obs: DataFrame) -> DataFrame:
    """Checks of observations that carry no quality flag of their own."""
    return anti(checks, keep_flagged(obs), ["ID", "DATE", "ELEMENT"])


def alternate_list(named: DataFrame, checks: DataFrame, reviewer: str) -> DataFrame:
    """Outliers the reviewer flagged or verified, over an older list with names.

    ``named`` has KEYS, FLAGGED, OUTLIER and name; ``checks`` has KEYS, FLAGGED
    and OUTLIER. An observation stays if the reviewer had it first, flagged it
    now, its value is zero, or the older mark is not positive; then one of the
    marks has to be non-zero and the older one wins.
    """
    a = named.select(*KEYS, "name", *[F.col(c).alias(f"{c}_x") for c in ("FLAGGED", "OUTLIER")])
    b = checks.select(*KEYS, *[F.col(c).alias(f"{c}_y") for c in ("FLAGGED", "OUTLIER")])
    both = a.join(b, KEYS, "full_outer").fillna(
        0, subset=["FLAGGED_x", "OUTLIER_x", "FLAGGED_y", "OUTLIER_y"])
    x, y = F.col("OUTLIER_x"), F.col("OUTLIER_y")
    kept = both.where((F.col("name") == reviewer) | (y != 0) | (F.col("VALUE") == 0) | (x <= 0))
    marked = kept.where((x != 0) | (y != 0)).select(*KEYS, F.when(x != 0, x).otherwise(y).alias("OUTLIER"))
    return strongest(marked)


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Non-zero marks found in one list only; ``SIDE`` names it."""
    def only(a, b, side):
        return anti(a, b, KEYS).where(F.col("OUTLIER") != 0).select(*KEYS, "OUTLIER", F.lit(side).alias("SIDE"))
    return only(first, second, "first").unionByName(only(second, first, "second"))
