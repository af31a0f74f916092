"""From depths and water equivalents to daily loads and their coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions import calendar, loads
from firnline.operators import rules

KEYS = ["ID", "cuID", "DATE", "wYEAR", "DOYA"]


def season_rows(obs: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Unflagged rows from October to May of the given seasons, VALUE in cm, with wYEAR."""
    rows = obs.withColumn("wYEAR", calendar.season_year("DATE")).where(
        F.col("wYEAR").between(first_year, last_year)
        & ((F.month("DATE") < 6) | (F.month("DATE") > 9)))
    rows = rules.fill_flags(rows)
    rows = rows.where((F.col("QFLAG") == " ") & (F.col("MFLAG") != "P"))
    return (rows.withColumn("VALUE", loads.to_cm(F.col("ELEMENT"), F.col("VALUE").cast("double")))
            .drop("QFLAG", "MFLAG", "SFLAG"))


def depth_loads(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """SNWD rows with the load by climate class (WEIGHT1) and by depth alone (WEIGHT2)."""
    d = rows.where(F.col("ELEMENT") == "SNWD").withColumn("DOYA", calendar.season_day("DATE"))
    d = d.join(classes, "climate", "left")
    h = F.col("VALUE")
    return d.select(*KEYS, "climate",
                    loads.sturm_load(h, F.col("DOYA"), *(F.col(c) for c in ("pmax", "po", "k1", "k2"))).alias("WEIGHT1"),
                    loads.rmcd_load(h).alias("WEIGHT2"), h.alias("SNWD"))


def water_loads(rows: DataFrame) -> DataFrame:
    w = rows.where(F.col("ELEMENT") == "WESD").withColumn("DOYA", calendar.season_day("DATE"))
    return w.select(*KEYS, (F.col("VALUE") * loads.CM_WATER_TO_KPA).alias("WEIGHT3"), F.col("VALUE").alias("WESD"))


def join_elements(depth: DataFrame, water: DataFrame) -> DataFrame:
    """Depth and water rows of a station and day side by side; either may be absent."""
    cond = [F.col(f"d.{k}").eqNullSafe(F.col(f"w.{k}")) for k in KEYS]
    joined = depth.alias("d").join(water.alias("w"), reduce(lambda a, b: a & b, cond), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"d.{k}"), F.col(f"w.{k}")).alias(k) for k in KEYS],
                         "climate", "WEIGHT1", "WEIGHT2", "SNWD", "WEIGHT3", "WESD")


def choose_weight(both: DataFrame, method: str = "Sturm") -> DataFrame:
    """WEIGHT from the water row, else converted from depth; direct = 1 where the water row counts.

    A load that is not positive gives way to a positive converted one. Rows
    without any load go.
    """
    if method not in ("Sturm", "RMCD"):
        raise ValueError(f"unknown conversion {method!r}")
    converted = F.col("WEIGHT1" if method == "Sturm" else "WEIGHT2")
    water = F.col("WEIGHT3")
    use_water = water.isNotNull() & ~((water <= 0) & F.coalesce(converted > 0, F.lit(False)))
    weight = F.when(use_water, water).otherwise(converted)
    return (both.withColumns({"WEIGHT": weight, "direct": use_water.cast("int"), "MONTH": F.month("DATE")})
            .where(F.col("WEIGHT") >= 0))


def daily_representative(rows: DataFrame, ties=("ID",)) -> DataFrame:
    """One row per cluster and day: direct ones first, then the largest, then the smallest id."""
    return rules.distinct_keep(rows, ["cuID", "DATE"], [-F.col("direct"), -F.col("WEIGHT"), *ties])


def season_maxima(daily: DataFrame) -> DataFrame:
    """Per cluster and season: maximum, its month, days and months observed."""
    rank = F.struct((-F.col("WEIGHT")).alias("v"), "DATE")
    return daily.groupBy("cuID", "wYEAR").agg(
        F.max("WEIGHT").alias("maxW"), F.count(F.lit(1)).alias("nday"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, MONTH)"))).alias("nmonth"),
        F.min_by("MONTH", rank).alias("wmonth"), F.min_by("ID", rank).alias("ID"))


def with_group(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    other = stats.withColumnRenamed(key, "_key")
    return df.join(other, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def covered(maxima: DataFrame) -> DataFrame:
    """Seasons with 30 days over 5 months, or a maximum above the cluster's median."""
    q = maxima.groupBy("cuID").agg(F.median("maxW").alias("q50"), F.percentile("maxW", F.lit(0.1)).alias("q10"),
                                   F.percentile("maxW", F.lit(0.25)).alias("q25"))
    return with_group(maxima, q, "cuID").where(
        ((F.col("nday") >= 30) & (F.col("nmonth") >= 5)) | (F.col("maxW") > F.col("q50")))


# Least log cutoff (25 psf), multiple of the quartile gap, believed
# number of high days, seasons a cluster needs.
LEAST_LOG_CUTOFF = 0.7871
GAP_MULTIPLE = 3
BELIEVED_DAYS = 5
MIN_SEASONS = 11


def outlier_bounds(maxima: DataFrame) -> DataFrame:
    """CUTOFF per cluster from the quartiles of the log maxima, never below the least one."""
    x = F.ln(F.col("maxW") + 1)
    q = maxima.groupBy("cuID").agg(F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"))
    level = F.greatest(GAP_MULTIPLE * (F.col("q75") - F.col("q25")) + F.col("q75"), F.lit(LEAST_LOG_CUTOFF))
    return q.select("cuID", (F.exp(level) - 1).alias("CUTOFF"))


def load_outliers(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows above the cutoff, unless the cluster has five or more of them in that season."""
    above = with_group(rows, bounds, "cuID").where(F.col("WEIGHT") > F.col("CUTOFF"))
    few = above.groupBy("cuID", "wYEAR").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < BELIEVED_DAYS)
    few = few.select(F.col("cuID").alias("_c"), F.col("wYEAR").alias("_y"))
    return above.join(few, F.col("cuID").eqNullSafe(F.col("_c")) & (F.col("wYEAR") == F.col("_y")), "left_semi").select(
        "cuID", "ID", "DATE", "WEIGHT", "CUTOFF")


def long_records(covered_maxima: DataFrame, min_seasons: int = MIN_SEASONS) -> DataFrame:
    """Clusters with more than ``min_seasons`` covered seasons, without their lowest tenth.

    Low seasons stay where the lower quartile is zero.
    """
    n = covered_maxima.groupBy("cuID").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_seasons)
    return with_group(covered_maxima, n, "cuID").where((F.col("maxW") > F.col("q10")) | (F.col("q25") == 0))
