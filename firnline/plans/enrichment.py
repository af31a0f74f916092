"""Station table with ecoregion, state record and county."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.loads import INCH_TO_MM
from firnline.operators import rules, spatial
from firnline.operators.quantiles import exact_quantiles
from firnline.operators.reshape import state_abbreviation
from firnline.session import cut_lineage

# Fixed value: the record the limits are taken from.
SNOW_DEPTH_RECORD = "All-Time Maximum Snow Depth"


def polygon_area(edges: DataFrame) -> DataFrame:
    """Planar area per polygon: outer rings minus holes, by the shoelace sum.

    Works for rings that run one way outside and the other way in holes.
    """
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges.groupBy("region_id", "poly_id").agg((F.abs(twice) / 2).alias("area"))


def largest_area(areas: DataFrame) -> DataFrame:
    return areas.groupBy("region_id").agg(F.max("area").alias("maxarea"))


def main_polygons(edges: DataFrame, areas: DataFrame, share: float = 0.9) -> DataFrame:
    """Edges of the polygons larger than the given quantile of all areas."""
    cut = exact_quantiles(areas, [], "area", {"_cut": share})
    # One row, attached to the polygon table (not to the edges) as a scalar.
    kept = areas.join(cut, F.col("area") > F.col("_cut")).select("region_id", "poly_id")
    return edges.join(kept, ["region_id", "poly_id"], "left_semi")


def add_ecoregion(stations: DataFrame, full: DataFrame, simple: DataFrame, border_deg: float = 2,
                  window_deg: float = 3) -> DataFrame:
    """ECO3 and ECO3_simp by containment, else from the nearest simplified region.

    Stations far from all regions are dropped. A station with no region within
    the window keeps null.
    """
    placed = spatial.assign_region(stations, full, "ECO3")
    placed = cut_lineage(spatial.assign_region(placed, simple, "ECO3_simp"))
    matched = placed.where(F.col("ECO3").isNotNull())
    others = placed.where(F.col("ECO3").isNull())
    near = cut_lineage(matched.unionByName(spatial.within_degrees(others, simple, border_deg)))
    missing = F.col("ECO3").isNull() | F.col("ECO3_simp").isNull()
    close = spatial.nearest_region(near.where(missing), simple, "_close", window_deg=window_deg).select(
        "ID", "_close")
    filled = near.join(close, "ID", "left")
    return filled.withColumns({c: F.coalesce(c, "_close") for c in ("ECO3", "ECO3_simp")}).drop("_close")


def state_records(records: DataFrame, states: dict[str, str]) -> DataFrame:
    """(STATE, STATE_MAX in mm) from rows State, Element, Notes (inches)."""
    abb = state_abbreviation(F.col("State"), states)
    return (records.where(F.col("Element") == SNOW_DEPTH_RECORD).withColumn("STATE", abb)
            .where(F.col("STATE").isNotNull())
            .select("STATE", (F.col("Notes").try_cast("double") * INCH_TO_MM).alias("STATE_MAX")).distinct())


def add_state_max(stations: DataFrame, records: DataFrame) -> DataFrame:
    return stations.join(records, "STATE", "left").select(*stations.columns, "STATE_MAX")


def add_county(stations: DataFrame, counties: DataFrame) -> DataFrame:
    """COUNTY by containment among the counties of the station's state, else the nearest of them.

    ``counties`` is an edge table with a STATE column. States without counties get null.
    """
    return spatial.nearest_region(stations, counties, "COUNTY", match=["STATE"])


def enrich(inventory: DataFrame, full: DataFrame, simple: DataFrame, records: DataFrame,
           counties: DataFrame) -> DataFrame:
    """All of it, from the raw inventory."""
    placed = add_ecoregion(rules.known_location(inventory), full, simple)
    return add_county(add_state_max(placed, records), counties)
