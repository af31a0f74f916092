"""Fixed-width daily files: one line is a station, month and element with 31 day slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.labels import region_match
from firnline.schema import MISSING_VALUE
from firnline.sources import manifest
from firnline.sources.scans import ELEMENTS

# Column positions of the format, counted from 1.
ID_AT = (1, 11)
YEAR_MONTH_AT = (12, 6)
ELEMENT_AT = (18, 4)
FIRST_SLOT = 22
SLOT_WIDTH = 8
VALUE_WIDTH = 5
DAYS = 31

#: Files of single stations: what their names match, and the station in the path.
GLOB, NAME = "*.dly", r"([^/]+)\.dly$"
#: The same for what ``write_station_files`` writes.
WRITTEN_GLOB, WRITTEN_NAME = "part-*", r"/ID=([^/]+)/"


def _slot(line: Column, day: Column) -> Column:
    """Day, value and the three one-letter flags of one slot."""
    at = FIRST_SLOT + (day - 1) * SLOT_WIDTH

    def flag(k):
        return line.substr(at + VALUE_WIDTH + k, F.lit(1))

    return F.struct(
        day.alias("d"),
        F.trim(line.substr(at, F.lit(VALUE_WIDTH))).try_cast("double").alias("v"),
        flag(0).alias("m"), flag(1).alias("q"), flag(2).alias("s"))


def parse_daily_lines(lines: DataFrame, elements=ELEMENTS, column: str = "value", keep=()) -> DataFrame:
    """Observations from raw lines, with the columns ``keep`` of ``lines``.

    Unwanted elements go before anything is expanded, and empty slots before the
    slots become rows. Slots beyond the end of a month are dropped.
    """
    line = F.col(column)
    wanted = lines.where(line.substr(*ELEMENT_AT).isin(*elements))
    first = F.try_to_date(line.substr(*YEAR_MONTH_AT), "yyyyMM")
    slots = F.filter(F.transform(F.sequence(F.lit(1), F.lit(DAYS)), lambda d: _slot(line, d)),
                     lambda s: s["v"].isNotNull() & (s["v"] != MISSING_VALUE))
    rows = wanted.select(line.substr(*ID_AT).alias("ID"), first.alias("_first"),
                         line.substr(*ELEMENT_AT).alias("ELEMENT"), *keep, F.explode(slots).alias("s"))
    return rows.where(F.col("s.d") <= F.dayofmonth(F.last_day("_first"))).select(
        "ID", F.date_add("_first", F.col("s.d") - 1).alias("DATE"), "ELEMENT",
        F.col("s.v").alias("VALUE"), F.col("s.m").alias("MFLAG"),
        F.col("s.q").alias("QFLAG"), F.col("s.s").alias("SFLAG"), *keep)


def format_daily_lines(obs: DataFrame) -> DataFrame:
    """The inverse: observations (one per station, element and day) as raw lines."""
    flag = {c: F.rpad(F.coalesce(F.col(c), F.lit("")), 1, " ") for c in ("MFLAG", "QFLAG", "SFLAG")}
    slot = F.concat(F.lpad(F.col("VALUE").cast("bigint").cast("string"), VALUE_WIDTH, " "),
                    flag["MFLAG"], flag["QFLAG"], flag["SFLAG"])
    empty = F.lit(f"{int(MISSING_VALUE):>{VALUE_WIDTH}}   ")
    months = obs.groupBy("ID", F.date_format("DATE", "yyyyMM").alias("_ym"), "ELEMENT").agg(
        F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("DATE"), slot))).alias("_slots"))
    days = F.transform(F.sequence(F.lit(1), F.lit(DAYS)),
                       lambda d: F.coalesce(F.try_element_at("_slots", d), empty))
    return months.select(F.concat(F.rpad(F.col("ID").cast("string"), ID_AT[1], " "), "_ym", "ELEMENT",
                                  F.array_join(days, "")).alias("value"))


def write_station_files(obs: DataFrame, folder: str) -> None:
    """A file for each station, in a folder ``ID=<station>`` of its own."""
    lines = format_daily_lines(obs).withColumn("ID", F.rtrim(F.col("value").substr(*ID_AT)))
    lines.repartition("ID").write.partitionBy("ID").text(folder)


def station_files(spark: SparkSession, source: str, glob: str = GLOB, name: str = NAME) -> DataFrame:
    """The manifest (path, ID, size) of the station files in ``source``."""
    return manifest.list_files(spark, source, name, glob)


def files_data(files: DataFrame, elements=ELEMENTS, path: bool = False) -> DataFrame:
    """Observations of the station files of a manifest; no other file is opened. With ``path`` each row names its file."""
    return parse_daily_lines(manifest.read_files(files), elements, keep=["path"] if path else [])


def get_station_data(spark: SparkSession, source: str, stations=None, elements=ELEMENTS) -> DataFrame:
    """Observations of the named stations, a list or a table with an ID column (all files without one).

    Station files that do not exist are skipped; :func:`missing_files` names them.
    No match gives an empty table with the full schema.
    """
    if stations is None:
        return parse_daily_lines(spark.read.option("pathGlobFilter", GLOB).text(source), elements)
    if not isinstance(stations, DataFrame):
        stations = spark.createDataFrame([(s,) for s in stations], "ID string")
    return files_data(_chosen(station_files(spark, source), stations), elements)


def _chosen(files: DataFrame, stations: DataFrame) -> DataFrame:
    return files.join(stations.select(F.col("ID").cast("string")).distinct(), "ID", "left_semi")


def get_state_data(spark: SparkSession, source: str, station_table: DataFrame, states,
                   elements=ELEMENTS) -> DataFrame:
    return get_station_data(spark, source, in_states(station_table, states), elements)


def get_region_data(spark: SparkSession, source: str, station_table: DataFrame, codes,
                    elements=ELEMENTS, exact: bool = False) -> DataFrame:
    return get_station_data(spark, source, in_regions(station_table, codes, exact), elements)


def in_states(station_table: DataFrame, states) -> DataFrame:
    return station_table.where(F.col("STATE").isin(*states))


def in_regions(station_table: DataFrame, codes, exact: bool = False) -> DataFrame:
    return station_table.where(region_match("ECO3", codes, exact))


def missing_files(spark: SparkSession, source: str, requested: DataFrame, glob: str = GLOB, name: str = NAME) -> DataFrame:
    """Requested station ids without a file in ``source``; file contents are not read."""
    present = station_files(spark, source, glob, name).select("ID")
    return requested.select("ID").distinct().join(present, "ID", "left_anti")
