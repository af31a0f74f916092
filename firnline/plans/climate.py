"""Climate covariates of stations from a cascade of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators import grid as grids
from firnline.operators import spatial
from firnline.session import cut_lineage

VARIABLES = ("PPTWT", "MCMT", "MWMT", "TD", "MAT")
# Areas in km2 that tell the mainland from islands and oceans, and large lakes.
MAINLAND = (1e07, 4e07)
LAKE_AREA = 20000
ISLAND_COAST_M = 1.0
RADII_M = (500, 1000, 1500, 8000)


def shore_layers(shores: DataFrame, lakes: DataFrame, islands: DataFrame) -> DataFrame:
    """Edges that count as coast: mainland, large lakes and island shores (tables with ``area``)."""
    a = F.col("area")
    return (shores.where((a > MAINLAND[0]) & (a < MAINLAND[1]))
            .unionByName(lakes.where(a > LAKE_AREA)).unionByName(islands.where(a < MAINLAND[0])))


def distance_to_coast(stations: DataFrame, shores: DataFrame, lakes: DataFrame, islands: DataFrame) -> DataFrame:
    return spatial.distance_to_layers_m(stations, shore_layers(shores, lakes, islands))


def covariates(stations: DataFrame, fine, second, third, coarse, variables=VARIABLES,
               id: str = "ID", key: str = "PPTWT") -> DataFrame:
    """Bilinear samples of three grids, each (table, spec), the next where the last has none.

    Stations outside all of them get the nearest cell of the coarse grid and
    count as islands: ``dist2coast`` (if present) becomes one metre.
    """
    out = grids.bilinear(stations, *fine, variables)
    for layer in (second, third):
        out = grids.fill_from(out, grids.bilinear(stations, *layer, variables), id, variables, key)
    out = cut_lineage(out)  # read several times from here on
    lost = out.where(F.col(key).isNull())
    last = grids.nearest_cell(lost.drop(*variables), coarse, variables)
    if "dist2coast" in stations.columns:
        last = last.withColumn("dist2coast", F.lit(ISLAND_COAST_M))
    return out.where(F.col(key).isNotNull()).unionByName(last)


def widening_sample(points: DataFrame, grid: DataFrame, spec, variables, radii_m=RADII_M, id: str = "ID",
                    key: str = "TD") -> DataFrame:
    """The cell's value, else the mean within the smallest radius that has one."""
    first = grids.cell_sample(points, grid, spec, variables)
    lost = first.where(F.col(key).isNull()).select(*points.columns)
    return grids.fill_from(first, grids.radius_means(lost, grid, variables, radii_m), id, variables, key)


def coarse_sample(points: DataFrame, grid: DataFrame, spec, variables, buffer_m: float = 10000, id: str = "ID",
                  key: str = "TD") -> DataFrame:
    """Bilinear sample, else the mean within a buffer."""
    first = grids.bilinear(points, grid, spec, variables)
    lost = first.where(F.col(key).isNull()).select(*points.columns)
    return grids.fill_from(first, grids.radius_means(lost, grid, variables, [buffer_m]), id, variables, key)
