"""Scans of an observation table restricted by element, station, state or region.

The station side is joined as a semi-join without a hint: Spark broadcasts it
while it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.labels import region_match

ELEMENTS = ("SNWD", "WESD")


def element_scan(obs: DataFrame, elements=ELEMENTS) -> DataFrame:
    return obs.where(F.col("ELEMENT").isin(*elements))


def station_scan(obs: DataFrame, stations: DataFrame, elements=ELEMENTS) -> DataFrame:
    return element_scan(obs, elements).join(stations.select("ID").distinct(), "ID", "left_semi")


def state_scan(obs: DataFrame, stations: DataFrame, states, elements=ELEMENTS) -> DataFrame:
    return station_scan(obs, stations.where(F.col("STATE").isin(*states)), elements)


def region_scan(obs: DataFrame, stations: DataFrame, codes, elements=ELEMENTS,
                exact: bool = False) -> DataFrame:
    """Stations whose region code starts with one of ``codes``; see ``region_pattern``."""
    return station_scan(obs, stations.where(region_match("ECO3", codes, exact)), elements)


def missing_stations(requested: DataFrame, obs: DataFrame) -> DataFrame:
    """Requested ids without a single observation."""
    return requested.select("ID").distinct().join(obs.select("ID"), "ID", "left_anti")
