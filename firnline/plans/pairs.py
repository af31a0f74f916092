"""How well close stations agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators import correlation, rules, spatial


def close_pair_study(stations: DataFrame, obs: DataFrame, max_km: float = 30, max_delev: float = 300,
                     min_n: int = 30) -> DataFrame:
    """Correlation of all close pairs of stations with data, by distance class."""
    observed = rules.semi(stations, obs, ["ID"]).where(F.col("ELEVATION").isNotNull())
    pairs = spatial.close_pairs(observed, max_km, max_delev)
    return correlation.classed(correlation.pair_correlation(pairs, obs, places=observed), min_n)
