"""Row-wise filters and small set operations used by every pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.schema import MISSING_COORDINATE, MISSING_ELEVATION_BELOW


def drop_presumed_zero(df: DataFrame) -> DataFrame:
    """Remove rows whose measurement flag says "missing, presumed zero"."""
    return df.where(F.col("MFLAG").isNull() | (F.col("MFLAG") != "P"))


def keep_unflagged(df: DataFrame) -> DataFrame:
    """Keep rows with an empty, blank or absent quality flag."""
    return df.where(F.col("QFLAG").isNull() | F.col("QFLAG").isin("", " "))


def keep_flagged(df: DataFrame) -> DataFrame:
    """Rows that carry a quality flag other than a blank."""
    return df.where(F.col("QFLAG") != " ")


def drop_months(df: DataFrame, months=(7, 8, 9), date: str = "DATE") -> DataFrame:
    return df.where(~F.month(date).isin(*months)) if months else df


def known_location(stations: DataFrame) -> DataFrame:
    """Stations that have a state and real coordinates."""
    return stations.where(
        F.col("STATE").isNotNull()
        & (F.col("ELEVATION") != MISSING_COORDINATE)
        & (F.col("LATITUDE") != MISSING_COORDINATE)
        & (F.col("LONGITUDE") != MISSING_COORDINATE))


def known_elevation(stations: DataFrame) -> DataFrame:
    return stations.where(F.col("ELEVATION") > MISSING_ELEVATION_BELOW)


def in_states(stations: DataFrame, states, max_latitude: float | None = None) -> DataFrame:
    kept = stations.where(F.col("ELEVATION").isNotNull() & F.col("STATE").isin(*states))
    return kept if max_latitude is None else kept.where(F.col("LATITUDE") <= max_latitude)


def drop_element_year(df: DataFrame, element: str = "WESD", year: int = 1952,
                      date: str = "DATE") -> DataFrame:
    """Remove one element in one calendar year; other elements stay, even without a date."""
    return df.where((F.year(date) != year) | (F.col("ELEMENT") != element))


def fill_flags(df: DataFrame, columns=("MFLAG", "QFLAG", "SFLAG")) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in columns})


def same_on(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition in which a null matches a null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def anti(df: DataFrame, removed: DataFrame, keys=None) -> DataFrame:
    """Rows of ``df`` without a partner in ``removed``, nulls matching nulls.

    Without ``keys`` every common column counts, so all duplicates of a removed
    row go with it.
    """
    keys = list(keys or [c for c in df.columns if c in removed.columns])
    other = removed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    return df.join(other, cond, "left_anti")


def semi(df: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def distinct_keep(df: DataFrame, keys, order) -> DataFrame:
    """One whole row per key, the first in ``order`` (a total order).

    ``min_by`` aggregates on the map side first, so a key with a huge number of
    copies is one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)
                         for c in df.columns])
