"""Sampling a climate grid at places.

A grid is a table of cells (row, col, x, y, one column per variable) with a
spec that turns coordinates into fractional rows and columns. Places are
reduced to the distinct cells they fall in before they meet the grid, so the
work follows the number of cells in use, not the number of places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import geodesy as geo
from firnline.operators.spatial import nearest, pairs_within
from firnline.session import cut_lineage


#: Cells that a cube of the least side holds in the mean.
SOME_CELLS = 3


@dataclass(frozen=True)
class GridSpec:
    """Centre of cell (0, 0) and the steps between centres."""

    x0: float
    y0: float
    dx: float
    dy: float

    def col(self, lon: Column) -> Column:
        return (lon - self.x0) / self.dx

    def row(self, lat: Column) -> Column:
        return (lat - self.y0) / self.dy


def bilinear(points: DataFrame, grid: DataFrame, spec: GridSpec, variables,
             lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Weighted mean of the four cells around each point; null if any is null or absent."""
    variables = list(variables)
    fr, fc = spec.row(F.col(lat)), spec.col(F.col(lon))
    placed = points.withColumns({"_r": F.floor(fr), "_c": F.floor(fc),
                                 "_u": fr - F.floor(fr), "_t": fc - F.floor(fc)})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    needed = (placed.select("_r", "_c").distinct().withColumn("_k", F.explode(corners))
              .select("_r", "_c", "_k", (F.col("_r") + F.col("_k.i")).alias("row"),
                      (F.col("_c") + F.col("_k.j")).alias("col")))
    cells = needed.join(grid.select(F.col("row").cast("long").alias("row"),
                                    F.col("col").cast("long").alias("col"), *variables), ["row", "col"])
    at = {(i, j): (F.col("_k.i") == i) & (F.col("_k.j") == j) for i in (0, 1) for j in (0, 1)}
    windows = cells.groupBy("_r", "_c").agg(
        *[F.max(F.when(at[k], F.col(v))).alias(f"_{v}{k[0]}{k[1]}") for v in variables for k in at])
    t, u = F.col("_t"), F.col("_u")

    def mix(v):
        low = F.col(f"_{v}00") * (1 - t) + F.col(f"_{v}01") * t
        high = F.col(f"_{v}10") * (1 - t) + F.col(f"_{v}11") * t
        return low * (1 - u) + high * u

    return placed.join(windows, ["_r", "_c"], "left").select(*points.columns, *[mix(v).alias(v) for v in variables])


def cell_sample(points: DataFrame, grid: DataFrame, spec: GridSpec, variables,
                lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Values of the cell each point falls in."""
    cells = grid.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), *variables)
    placed = points.withColumns({"_r": F.floor(spec.row(F.col(lat)) + 0.5),
                                 "_c": F.floor(spec.col(F.col(lon)) + 0.5)})
    return placed.join(cells, ["_r", "_c"], "left").select(*points.columns, *variables)


def _celled(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    df = geo.add_vector(df, "p", x, y)
    return df.withColumns({f"c{a}": F.floor(F.col(f"p{a}") / size) for a in "xyz"})


def _meeting(places: DataFrame, cells: DataFrame, size: float, lon: str, lat: str) -> DataFrame:
    """Places with the cells (as ``r_<name>``) in the same or adjoining cubes of side ``size``."""
    return pairs_within(_celled(places, lon, lat, size), _celled(cells, "x", "y", size), ["cx", "cy", "cz"], size=size)


def _spacing(cells: DataFrame) -> float:
    """The least side, by halves, at which cubes that hold cells hold some of them in the mean."""
    sides = [2.0 ** -k for k in range(1, 21)]
    vectors = geo.add_vector(cells, "p", "x", "y")
    used = vectors.agg(F.count("px").alias("n"), *[F.approx_count_distinct(
        F.xxhash64(*[F.floor(F.col(f"p{a}") / side) for a in "xyz"])).alias(f"_{k}") for k, side in enumerate(sides)]).first()
    return min(side for k, side in enumerate(sides) if k == 0 or used["n"] >= SOME_CELLS * used[f"_{k}"])


def nearest_cell(points: DataFrame, grid: DataFrame, variables, lon: str = "LONGITUDE",
                 lat: str = "LATITUDE") -> DataFrame:
    """Values of the cell whose centre is nearest on the sphere; ties to the lower row, column.

    Most places have a cell within the spacing of the grid, and are settled by
    joins in cubes of that side and a larger one. Those far from all cells
    descend through tiles.
    """
    variables = list(variables)
    cells = grid.select("row", "col", "x", "y", *variables)
    left = cut_lineage(points.select(lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).distinct())
    apart = geo.chord(geo.cols("p"), geo.cols("r_p"))
    least, found = _spacing(cells), []
    for size in (least, 8 * least):
        near = _meeting(left, cells, size, lon, lat).select(
            lon, lat, apart.alias("_d"), *[F.col(f"r_{c}").alias(c) for c in ("row", "col", *variables)]).where(F.col("_d") <= size)
        best = near.groupBy(lon, lat).agg(F.min(F.struct("_d", "row", "col", *variables)).alias("_best"))
        found.append(cut_lineage(best.select(lon, lat, *[F.col(f"_best.{v}").alias(v) for v in variables])))
        left = cut_lineage(left.join(found[-1], [lon, lat], "left_anti"))
        if left.isEmpty():
            break
    else:
        spots = cells.withColumnsRenamed({"x": "x1", "y": "y1"}).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
        found.append(nearest(left, spots, carry=["row", "col", *variables], lon=lon, lat=lat).select(lon, lat, *variables))
    return points.join(reduce(DataFrame.unionByName, found), [lon, lat], "left").select(*points.columns, *variables)


def radius_means(points: DataFrame, grid: DataFrame, variables, radii_m, radius_km=geo.PAIR_RADIUS_KM,
                 lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Mean over the cells within the smallest of ``radii_m`` that holds a value, nulls skipped.

    Each radius has a join in cells of its own size, and only of the places
    that a smaller one has left without a value of some variable.
    """
    variables, radii = list(variables), sorted(radii_m)

    cells = grid.select("x", "y", *variables).where(F.coalesce(*variables).isNotNull())
    chord = geo.chord(geo.cols("p"), geo.cols("r_p"))
    metres = geo.chord_to_km(chord, radius_km) * 1000
    left = points.select(lon, lat).distinct()
    found = []
    for k, r in enumerate(radii):
        size = max(r / 1000 / radius_km, 1e-6)
        # The chord is shorter than the arc, so it rules out most cells without an arc sine.
        met = _meeting(left, cells, size, lon, lat).where(
            (chord <= size * (1 + 1e-9)) & (metres <= r))
        mine = met.groupBy(lon, lat).agg(*[F.avg(f"r_{v}").alias(v) for v in variables])
        if k + 1 < len(radii):
            mine = cut_lineage(mine)
            whole = mine.where(" and ".join(f"`{v}` is not null" for v in variables)).select(lon, lat)
            left = cut_lineage(left.join(whole, [lon, lat], "left_anti"))
        found.append(mine.withColumn("_k", F.lit(k)))
        if k + 1 < len(radii) and left.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy(lon, lat).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_k"))).alias(v) for v in variables])
    return points.join(best, [lon, lat], "left").select(*points.columns, *variables)


def coarsen(grid: DataFrame, factor: int, variables) -> DataFrame:
    """Blocks of ``factor`` by ``factor`` cells as one cell, means with nulls skipped."""
    return grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), *[F.avg(v).alias(v) for v in variables])


def fill_from(first: DataFrame, second: DataFrame, id: str, variables, key: str) -> DataFrame:
    """Take all variables of a row from ``second`` where ``key`` is null in ``first``."""
    other = second.select(F.col(id).alias("_id"), *[F.col(v).alias(f"_{v}") for v in variables])
    joined = first.join(other, F.col(id) == F.col("_id"), "left")
    rest = [c for c in first.columns if c not in variables]
    return joined.select(*rest, *[F.when(F.col(key).isNull(), F.col(f"_{v}")).otherwise(F.col(v)).alias(v)
                                  for v in variables])
