"""Daily depths and water equivalents to design loads per station cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions import loads as conv
from firnline.functions.labels import parent_region
from firnline.operators import fitting, loads, rules, spatial
from firnline.operators.reshape import row_median
from firnline.session import cut_lineage

MISSING_BASIN = 99999999


def daily_loads(obs: DataFrame, stations: DataFrame, first_year: int = 1967, last_year: int = 2018,
                method: str = "Sturm") -> DataFrame:
    """One load per station and day; stations need ID, cuID and climate."""
    rows = loads.season_rows(obs, first_year, last_year).join(
        stations.select("ID", "cuID", "climate"), "ID", "left")
    classes = conv.snow_classes(obs.sparkSession)
    both = loads.join_elements(loads.depth_loads(rows, classes), loads.water_loads(rows))
    return loads.choose_weight(both, method)


def outliers_of(daily: DataFrame) -> DataFrame:
    return loads.load_outliers(daily, loads.outlier_bounds(loads.covered(
        loads.season_maxima(loads.daily_representative(daily)))))


def cluster_summary(stations: DataFrame, observed: DataFrame) -> DataFrame:
    """Name and state of the first station, mean place and number of stations per cluster."""
    kept = rules.semi(rules.known_elevation(stations), observed, ["ID"])
    return kept.groupBy("cuID").agg(
        F.min_by("NAME", "ID").alias("NAME"), F.min_by("STATE", "ID").alias("STATE"),
        F.avg("LATITUDE").alias("LATITUDE"), F.avg("LONGITUDE").alias("LONGITUDE"),
        F.avg("ELEVATION").alias("ELEVATION"), F.min_by("ECO3", "ID").alias("REGIONIII"),
        F.min_by("climate", "ID").alias("climate"), F.count(F.lit(1)).alias("numST"))


def design_loads(obs: DataFrame, stations: DataFrame, first_year: int = 1967, last_year: int = 2018,
                 method: str = "Sturm", remove_outliers: bool = True, min_seasons: int = loads.MIN_SEASONS):
    """(load table, outliers, covered maxima).

    The outlier table carries ``relevant``, 1 where its cluster got a load. It is
    empty when outliers are kept.
    """
    daily = cut_lineage(daily_loads(obs, stations, first_year, last_year, method))
    outliers = cut_lineage(outliers_of(daily))
    if remove_outliers:
        daily = rules.anti(daily, outliers, ["cuID", "ID", "DATE"])
    else:
        outliers = outliers.limit(0)
    maxima = cut_lineage(loads.long_records(loads.covered(loads.season_maxima(
        loads.daily_representative(daily))), min_seasons))
    levels = fitting.load_summary(maxima, "cuID", "maxW").withColumnRenamed("cuID", "_key")
    places = cluster_summary(stations, daily)
    table = places.join(levels, F.col("cuID").eqNullSafe(F.col("_key"))).drop("_key")
    table = table.withColumn("REGIONII", parent_region("REGIONIII")).withColumn("REGIONI", parent_region("REGIONII"))
    known = table.select(F.col("cuID").alias("_key"), F.lit(1).alias("relevant"))
    outliers = outliers.join(known, F.col("cuID").eqNullSafe(F.col("_key")), "left").drop("_key").fillna(
        0, subset=["relevant"])
    return table, outliers, maxima


def final_table(tables, basins: DataFrame) -> DataFrame:
    """Load tables of several areas as one, with the water basin and the median load.

    The load is the median of five distributions, to three decimals. Rounding is
    half to even.
    """
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    table = spatial.assign_region(table, basins, "HUC")
    return table.select(
        "cuID", "NAME", "STATE", F.bround("LATITUDE", 3).alias("LATITUDE"),
        F.bround("LONGITUDE", 3).alias("LONGITUDE"), F.bround("ELEVATION", 0).cast("int").alias("ELEVATION"),
        "REGIONIII", "climate",
        F.coalesce(F.col("HUC").try_cast("long"), F.lit(MISSING_BASIN)).alias("HUC"), "numST", "numMax",
        F.bround("medMax", 3).alias("medMax"), F.bround("mMax", 3).alias("mMax"),
        row_median("DLL", "DLG", "DLI", "DLII", "DLIII", digits=3).alias("load"))
