"""Daily files as a stream.

Parsing and the row-wise rules keep no state, so the batch functions run
unchanged on a streaming DataFrame. The rules that look at other rows
(county limits, high maxima, corrupt years) stay batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.operators import qc
from firnline.sources.daily import parse_daily_lines
from firnline.sources.scans import ELEMENTS


def daily_stream(spark: SparkSession, source: str, elements=ELEMENTS) -> DataFrame:
    lines = spark.readStream.option("pathGlobFilter", "*.dly").text(source)
    return parse_daily_lines(lines, elements)


def clean_stream(obs: DataFrame, stations: DataFrame | None = None, months=(7, 8, 9)) -> DataFrame:
    """Flag and season rules, and the state limit where a station table is given."""
    names = ["all"] + (["state_max"] if stations is not None else [])
    return qc.clean_station_data(obs, names, months=months, stations=stations)
