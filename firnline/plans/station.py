"""Cluster, clean, take water-year maxima, fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators import cluster, fitting, maxima, qc, rules
from firnline.session import cut_lineage
from firnline.sources.scans import region_scan


def station_fits(obs: DataFrame, distr: str = "lnorm", method: str = "mle", id: str = "ID", **fit) -> DataFrame:
    """Row rules, maxima per id over all elements, one fit per id."""
    ym = maxima.yearly_maximums(qc.clean_station_data(obs), id, "DATE", "VALUE")
    return fitting.fit_dist(ym, id, "MAX", distr, method, **fit)


def clustered_fits(obs: DataFrame, stations: DataFrame, region_codes=None, dist_adj: float = 1,
                   elev_adj: float = 10, h: float = 2) -> DataFrame:
    """Log-normal fits per station cluster, clusters formed within ecoregions."""
    known = stations.where(F.col("ELEVATION").isNotNull())
    grouped = cluster.cluster_stations(known, dist_adj, elev_adj, h, group="ECO3", label=True)
    rows = obs if region_codes is None else region_scan(obs, stations, region_codes)
    clean = qc.clean_station_data(rows).join(grouped.select("ID", "CLUST"), "ID", "left")
    ym = maxima.yearly_maximums(clean, "CLUST", "DATE", "VALUE")
    return fitting.fit_dist(ym, "CLUST", "MAX", "lnorm")


CLIMATE = ("TD", "FFP", "MCMT", "MWMT", "PPTWT", "RH", "MAT", "D2C")


def depth_maxima(obs: DataFrame, stations: DataFrame, states, max_latitude: float = 51, dist_adj: float = 1,
                 elev_adj: float = 16, h: float = 4, prioritize: str = "WESD", n: int = 10,
                 months: int = 3) -> tuple[DataFrame, DataFrame]:
    """Covered yearly maxima per cluster, and the clustered stations they come from.

    All ecoregions in one job: clusters never cross an ecoregion, so grouping by
    cluster is what a loop over ecoregions would do.
    """
    kept = rules.in_states(stations, states, max_latitude)
    grouped = cut_lineage(cluster.cluster_stations(kept, dist_adj, elev_adj, h, group="ECO3", label=True))
    rows = obs.join(grouped.select("ID", "CLUST"), "ID")
    clean = qc.clean_station_data(rows, ["mpzero", "qflag", "month", "high_max"], max_grouping="CLUST",
                                  iqr_cutoff=3, max_yearly_outliers=5)
    ym = maxima.yearly_maximums(clean, "CLUST", "DATE", "VALUE", value_type="ELEMENT",
                                prioritize=prioritize, n=n, months=months)
    return maxima.coverage_filter(ym, "CLUST", 5, n, months), grouped


def cluster_places(grouped: DataFrame, climate: DataFrame | None = None, variables=CLIMATE) -> DataFrame:
    """Mean place and climate per cluster."""
    if climate is None:
        variables, joined = (), grouped
    else:
        joined = grouped.join(climate.select("ID", *variables), "ID", "left")
    return joined.groupBy("CLUST").agg(*[F.avg(c).alias(c) for c in ("LATITUDE", "LONGITUDE", "ELEVATION", *variables)])


def cluster_medians(ym: DataFrame) -> DataFrame:
    return ym.groupBy("CLUST").agg(F.median("MAX").alias("max"),
                                   F.bround(F.median("MAX_MONTH"), 0).cast("int").alias("month"))


def depth_table(ym: DataFrame, grouped: DataFrame, climate: DataFrame | None = None, variables=CLIMATE) -> DataFrame:
    """Median maximum and month per cluster with its place and climate."""
    return cluster_medians(ym).join(cluster_places(grouped, climate, variables), "CLUST", "left")
