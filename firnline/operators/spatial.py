"""Spatial joins: close pairs, containment, nearest edges, region distances.

No join compares every row with every row. Pairs within a radius meet in grid
cells of that radius, each pair from one side. Containment has a cover of cells
for each polygon: inner cells are the answer, and in cells on its border the
edges of that cell decide. Nearest neighbours descend through tiles: from one
tile for the globe down, bounds between tiles decide which can hold the nearest
edge, and only those are split further. Places are reduced to distinct
coordinates first, so many copies of one place cost one place.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions import geodesy as geo
from firnline.session import Scratch, cut_lineage

#: Cells of a polygon's cover along its longer side: this many to twice as many.
COVER = 16
#: Sides of the tiles below the one tile that is the globe.
TILES_DEG = (30.0, 4.0, 0.5)


# --- pairs within a radius --------------------------------------------------------

def _neighbourhood(dims) -> list[list[int]]:
    out = [[]]
    for _ in dims:
        out = [o + [d] for o in out for d in (-1, 0, 1)]
    return out


def pairs_within(left: DataFrame, right: DataFrame, cell_columns, match=(), size: float | None = None) -> DataFrame:
    """Join rows whose integer cells (columns of both sides) differ by at most one.

    ``left`` keeps its column names but those of the cells; columns of ``right`` come as ``r_<name>``.
    With ``size`` the first three cells are those of unit vectors, of that
    size, and adjoining ones that the sphere does not reach are left out.
    """
    cells = list(cell_columns)
    shifts = F.array(*[F.struct(*[F.lit(d).cast("long").alias(c) for c, d in zip(cells, ds)])
                       for ds in _neighbourhood(cells)])
    wide = left.withColumn("_shift", F.explode(shifts))
    for c in cells:
        wide = wide.withColumn(f"_k{c}", F.col(c) + F.col(f"_shift.{c}"))
    wide = wide.drop("_shift", *cells)
    if size is not None:
        wide = wide.where(_reached([F.col(f"_k{c}") for c in cells[:3]], size))
    other = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    cond = [F.col(f"_k{c}") == F.col(f"r_{c}") for c in cells]
    cond += [F.col(m).eqNullSafe(F.col(f"r_{m}")) for m in match]
    joined = wide.join(other, cond)
    return joined.drop(*[f"_k{c}" for c in cells])


def _cells(df: DataFrame, km: float, metres: float | None, elev: str,
           lon: str, lat: str, radius: float) -> tuple[DataFrame, list[str]]:
    df = geo.add_vector(df, "p", lon, lat)
    size = max(km / radius, 1e-6)
    out = {f"c{a}": F.floor(F.col(f"p{a}") / size) for a in "xyz"}
    if metres is not None:
        out["ce"] = F.floor(F.col(elev) / max(metres, 1e-6))
    return df.withColumns(out), list(out)


def _reached(cells: list[Column], size: float) -> Column:
    """Whether a cell of the unit vectors' space has a part of the sphere in it."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in cells:
        low, high = c * size, (c + 1) * size
        near += F.when((c >= 0), low * low).when(c < -1, high * high).otherwise(0.0)
        far += F.greatest(low * low, high * high)
    return (near <= 1 + 1e-9) & (far >= 1 - 1e-9)


def half_pairs(rows: DataFrame, cells: list[str], id: str, size: float, match=()) -> DataFrame:
    """Each pair of ``rows`` in the same or adjoining ``cells`` once, the columns of one as ``r_<name>``.

    A row looks for partners in its own cell, of larger ids only, and in those
    adjoining cells that come after its own in lexicographic order: half of
    all. The first three cells are those of unit vectors; adjoining ones that
    the sphere does not reach are left out.
    """
    ahead = [d for d in product((-1, 0, 1), repeat=len(cells)) if d >= (0,) * len(cells)]
    shifts = F.array(*[F.struct(*[F.lit(d).cast("long").alias(c) for c, d in zip(cells, ds)]) for ds in ahead])
    wide = rows.withColumn("_shift", F.explode(shifts))
    wide = wide.withColumns({f"_k{c}": F.col(c) + F.col(f"_shift.{c}") for c in cells}).withColumn(
        "_own", F.expr(" and ".join(f"_shift.{c} = 0" for c in cells))).drop("_shift")
    wide = wide.where(F.col("_own") | _reached([F.col(f"_k{c}") for c in cells[:3]], size))
    other = rows.select([F.col(c).alias(f"r_{c}") for c in rows.columns])
    cond = [F.col(f"_k{c}") == F.col(f"r_{c}") for c in cells] + [F.col(m).eqNullSafe(F.col(f"r_{m}")) for m in match]
    met = wide.join(other, cond).where((F.col(id) != F.col(f"r_{id}")) & (~F.col("_own") | (F.col(id) < F.col(f"r_{id}"))))
    return met.drop("_own", *[f"_k{c}" for c in cells])


def close_pairs(stations: DataFrame, max_km: float, max_delev: float, id: str = "ID",
                lon: str = "LONGITUDE", lat: str = "LATITUDE", elev: str = "ELEVATION",
                match=(), radius: float = geo.PAIR_RADIUS_KM) -> DataFrame:
    """Unordered pairs within ``max_km`` and ``max_delev``: ID1 < ID2, middle place, DIST, DELEV."""
    base, cells = _cells(stations.select(id, lon, lat, elev, *match), max_km, max_delev, elev, lon, lat, radius)
    both = half_pairs(base, cells, id, max(max_km / radius, 1e-6), match)
    dist = geo.chord_to_km(geo.chord(geo.cols("p"), geo.cols("r_p")), radius)
    delev = F.abs(F.col(elev) - F.col(f"r_{elev}"))
    return (both.where(delev <= max_delev)
            .select(*match, F.least(id, f"r_{id}").alias("ID1"), F.greatest(id, f"r_{id}").alias("ID2"),
                    ((F.col(lon) + F.col(f"r_{lon}")) / 2).alias("AVE_LON"),
                    ((F.col(lat) + F.col(f"r_{lat}")) / 2).alias("AVE_LAT"),
                    ((F.col(elev) + F.col(f"r_{elev}")) / 2).alias("AVE_ELEV"),
                    dist.alias("DIST"), delev.alias("DELEV"))
            .where(F.col("DIST") <= max_km))


def dissimilarity_pairs(stations: DataFrame, dist_adj: float, elev_adj: float, h: float,
                        id: str = "ID", lon: str = "LONGITUDE", lat: str = "LATITUDE",
                        elev: str = "ELEVATION", match=()) -> DataFrame:
    """Pairs whose score km / dist_adj + |elevation gap| / elev_adj is at most ``h``."""
    pairs = close_pairs(stations, h * dist_adj * (1 + 1e-9), h * elev_adj * (1 + 1e-9),
                        id, lon, lat, elev, match)
    score = F.col("DIST") / dist_adj + F.col("DELEV") / elev_adj
    return pairs.select(*match, "ID1", "ID2", score.alias("SCORE")).where(F.col("SCORE") <= h)


# --- containment --------------------------------------------------------------------

def _met_at(y: Column) -> Column:
    """Where the edge is met at height ``y``; null for level edges."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))


def _left(x: Column, y: Column) -> Column:
    """Whether the edge is met to the right of (x, y), on its height."""
    return x < _met_at(y)


def _under(x: Column, y: Column) -> Column:
    """Whether the edge is met above (x, y); by the side that ``_left`` tells, so that both agree where rounding decides."""
    rising = (F.col("x2") > F.col("x1")) == (F.col("y2") > F.col("y1"))
    return F.when(F.col("y1") == F.col("y2"), y < F.col("y1")).otherwise(_left(x, y) != rising)


def _passed(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def polygon_cover(edges: DataFrame, match=()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inner cells, edges by border cell, border cells) of each polygon, for ``point_in_polygon``.

    Cells are squares of side 2^level degrees, the level by the polygon's
    extent, so a cover has some hundred cells whatever the polygon's size is. A
    border cell has the parity of crossings to the right of its upper right
    corner. A run of cells between two border cells of a row has no edge, so it
    is inside as a whole or outside.
    """
    poly = ["region_id", "poly_id", *match]
    low_x, high_x, low_y, high_y = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    extent = F.greatest(F.max(high_x) - F.min(low_x), F.max(high_y) - F.min(low_y))
    level = F.greatest(F.ceil(F.log2(extent / (2 * COVER))), F.lit(-40)).cast("int").alias("level")
    boxes = edges.groupBy(*poly).agg(level).where("level is not null")
    sized = edges.join(boxes, poly).withColumn("_size", F.pow(F.lit(2.0), F.col("level")))
    # The rows that an edge passes, and in each the cells between its ends there. Neighbours within rounding count too.
    slack, size = F.lit(1e-9), F.col("_size")
    rows = sized.withColumn("j", F.explode(F.sequence(F.floor(low_y / size - slack), F.floor(high_y / size + slack))))
    bottom, top = F.greatest(F.col("j") * size, low_y), F.least((F.col("j") + 1) * size, high_y)

    def at(y):
        return F.least(F.greatest(_met_at(y), low_x), high_x)
    level_edge = F.col("y1") == F.col("y2")
    start = F.when(level_edge, low_x).otherwise(F.least(at(bottom), at(top)))
    stop = F.when(level_edge, high_x).otherwise(F.greatest(at(bottom), at(top)))
    local = rows.withColumn("i", F.explode(F.sequence(F.floor(start / size - slack), F.floor(stop / size + slack))))
    cells = local.select(*poly, "level", "_size", "i", "j").distinct()
    # Corners and crossings of each line of cells from the right: the crossings before a corner are those to its right.
    # (An edge that starts on a line passes it, as the line counts as a little above itself.)
    lines = sized.withColumn("j", F.explode(F.sequence(F.floor(low_y / size) - 1, F.floor(high_y / size)))).where(
        ~level_edge & _passed((F.col("j") + 1) * size))
    y_top = (F.col("j") + 1) * size
    crossings = lines.select(*poly, "level", "j", F.lit(None).cast("long").alias("i"),
                             _met_at(y_top).alias("_x"), F.lit(1).alias("_c"))
    corners = cells.select(*poly, "level", "j", "i", ((F.col("i") + 1) * size).alias("_x"), F.lit(0).alias("_c"))
    order = Window.partitionBy(*poly, "level", "j").orderBy(F.desc("_x"), "_c").rowsBetween(Window.unboundedPreceding, 0)
    border = (corners.union(crossings).withColumn("_odd", F.sum("_c").over(order) % 2).where("_c = 0")
              .select(*poly, "level", "i", "j", "_odd"))
    next_i = F.lead("i").over(Window.partitionBy(*poly, "level", "j").orderBy("i"))
    inner = (border.withColumn("_next", next_i).where("_odd = 1 and _next > i + 1")
             .withColumn("i", F.explode(F.sequence(F.col("i") + 1, F.col("_next") - 1))).select(*poly, "level", "i", "j"))
    return inner, local.select(*poly, "level", "_size", "i", "j", "x1", "y1", "x2", "y2"), border


def point_in_polygon(points: DataFrame, edges: DataFrame, lon: str = "LONGITUDE", lat: str = "LATITUDE", match=()) -> DataFrame:
    """Every (place, polygon) with the place inside: distinct lon, lat, [match], region_id, poly_id.

    Crossing parity over all rings of a polygon, so holes count as outside. Left
    and bottom borders belong to a polygon, right and top ones do not. ``match``
    columns exist on both sides and have to agree.

    A place meets the polygons that have its cell in their cover. In a border
    cell the way from the place to the right side of the cell and up to its
    corner is followed, which only edges of that cell can cross.
    """
    match = list(match)
    with Scratch(points.sparkSession) as scratch:
        inner, local, border = (scratch.cut(t) for t in polygon_cover(edges, match))
        levels = sorted(r.level for r in border.select("level").distinct().collect())  # a few dozen numbers at most
        places = points.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), *match).where(
            F.col(lon).isNotNull() & F.col(lat).isNotNull()).distinct()
        x, y = F.col("_lon"), F.col("_lat")
        side = F.pow(F.lit(2.0), F.col("level"))
        placed = places.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumns(
            {"i": F.floor(x / side), "j": F.floor(y / side)})
        cell, keep = ["level", "i", "j", *match], ["_lon", "_lat", *match, "region_id", "poly_id"]
        whole = placed.join(inner, cell).select(*keep)
        right, top = (F.col("i") + 1) * F.col("_size"), (F.col("j") + 1) * F.col("_size")
        across = (F.col("y1") != F.col("y2")) & _passed(y) & _left(x, y) & ~_left(right, y)
        up = ((F.col("x1") > right) != (F.col("x2") > right)) & (_under(right, y) != _under(right, top))
        crossed = F.sum(F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int"))
        met = placed.join(local, cell).groupBy(*keep, "level", "i", "j").agg(crossed.alias("_n"))
        partly = met.join(border, [*cell, "region_id", "poly_id"]).where((F.col("_n") + F.col("_odd")) % 2 == 1).select(*keep)
        found = whole.union(partly).select(x.alias(lon), y.alias(lat), *match, "region_id", "poly_id")
        return cut_lineage(found)


def assign_region(points: DataFrame, edges: DataFrame, out: str = "region_id",
                  lon: str = "LONGITUDE", lat: str = "LATITUDE", match=()) -> DataFrame:
    """Add the region that contains each point, the first in name order, or null."""
    inside = point_in_polygon(points, edges, lon, lat, match)
    one = inside.groupBy(lon, lat, *match).agg(F.min("region_id").alias(out))
    return points.join(one, [lon, lat, *match], "left").select(*points.columns, out)


# --- nearest edges ---------------------------------------------------------------------

def _tile(df: DataFrame, x, y, size: float, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}i": F.floor(x / size), f"{prefix}j": F.floor(y / size)})


def _centre(prefix: str, size: float, metric: str):
    return geo.vector((F.col(f"{prefix}i") + 0.5) * size, (F.col(f"{prefix}j") + 0.5) * size, metric)


def nearest(points: DataFrame, edges: DataFrame, by=(), carry=(), match=(), metric: str = geo.SPHERE,
            limit: float | None = None, window_deg: float | None = None,
            lon: str = "LONGITUDE", lat: str = "LATITUDE", tiles=TILES_DEG) -> DataFrame:
    """Distance from each distinct place to the nearest edge of each ``by`` group.

    Returns lon, lat, [match], [by], ``_dist`` (straight-line units of the metric)
    and the ``carry`` columns of the nearest edge, ties in their order. ``limit``
    drops what is farther. ``match`` columns have to agree. ``window_deg`` keeps
    only edges whose box meets the square of that half-width around the place.
    """
    by, carry, match = list(by), list(carry), list(match)
    prune = window_deg is None
    places = points.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), *match).where(
        F.col(lon).isNotNull() & F.col(lat).isNotNull()).distinct()
    places = geo.add_vector(places, "p", "_lon", "_lat", metric)
    segs = geo.prepare_segments(edges, metric)
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2

    # One tile for the globe, then smaller ones: each level splits the pairs of tiles that the bounds of the last one left.
    # (A number of the row, not a literal: as a constant the key would drop out of the joins.)
    places = places.withColumn("P", F.floor(F.col("_lon") * 0))
    segs = segs.withColumn("E", F.floor(mid_x * 0))
    candidates = segs.select(*match, *by, F.col("E").alias("P"), "E").distinct()
    keys = ["P", "E"]
    for level, size in enumerate(tiles):
        pk, ek = [f"P{level}i", f"P{level}j"], [f"E{level}i", f"E{level}j"]
        places = _tile(places, F.col("_lon"), F.col("_lat"), size, f"P{level}")
        segs = _tile(segs, mid_x, mid_y, size, f"E{level}")
        centre_p = [c.alias(f"m{a}") for a, c in zip("xyz", _centre(f"P{level}", size, metric))]
        centre_e = [c.alias(f"q{a}") for a, c in zip("xyz", _centre(f"E{level}", size, metric))]
        older_p = [k for k in keys if k.startswith("P")]
        older_e = [k for k in keys if k.startswith("E")]
        reach_p = F.max(geo.chord(geo.cols("p"), _centre(f"P{level}", size, metric)))
        ce = _centre(f"E{level}", size, metric)
        reach_e = F.max(F.greatest(geo.chord(geo.cols("a"), ce), geo.chord(geo.cols("b"), ce)))
        tp = places.groupBy(*match, *older_p, *pk).agg(reach_p.alias("_rp")).select("*", *centre_p)
        te = segs.groupBy(*match, *by, *older_e, *ek).agg(reach_e.alias("_re")).select("*", *centre_e)
        pairs = candidates.join(tp, [*match, *older_p]).join(te, [*match, *by, *older_e])
        apart = geo.chord(geo.cols("m"), geo.cols("q"))
        slack = F.col("_rp") + F.col("_re")
        pairs = pairs.select(*match, *by, *older_p, *pk, *older_e, *ek,
                             (apart - slack - 1e-12).alias("_low"), (apart + slack).alias("_high"))
        if limit is not None:
            pairs = pairs.where(F.col("_low") <= limit)
        if prune:
            # At most one row per tile of the globe in each of these windows.
            around = Window.partitionBy(*match, *by, *older_p, *pk)
            pairs = pairs.withColumn("_cap", F.min("_high").over(around)).where(F.col("_low") <= F.col("_cap"))
        keys = [*older_p, *pk, *older_e, *ek]
        candidates = pairs.select(*match, *by, *keys)

    own_p = [k for k in keys if k.startswith("P")]
    own_e = [k for k in keys if k.startswith("E")]
    met = places.join(candidates, [*match, *own_p]).join(segs, [*match, *by, *own_e])
    if window_deg is not None:
        met = met.where((F.greatest("x1", "x2") >= F.col("_lon") - window_deg)
                        & (F.least("x1", "x2") <= F.col("_lon") + window_deg)
                        & (F.greatest("y1", "y2") >= F.col("_lat") - window_deg)
                        & (F.least("y1", "y2") <= F.col("_lat") + window_deg))
    d = geo.segment_distance(geo.cols("p"), metric)
    keep = ["_lon", "_lat", *match, *by]
    if carry:
        found = met.withColumn("_d", d).groupBy(*keep).agg(
            F.min(F.struct("_d", *carry)).alias("_best")).select(
            *keep, F.col("_best._d").alias("_dist"), *[F.col(f"_best.{c}").alias(c) for c in carry])
    else:
        found = met.groupBy(*keep).agg(F.min(d).alias("_dist"))
    if limit is not None:
        found = found.where(F.col("_dist") <= limit)
    return found.withColumnsRenamed({"_lon": lon, "_lat": lat})


def km_to_chord(km: float, radius: float = geo.POLYGON_RADIUS_KM) -> float:
    return 2 * math.sin(min(km / (2 * radius), math.pi / 2))


def _km(c, radius: float = geo.POLYGON_RADIUS_KM):
    return geo.chord_to_km(c, radius)


def place_region_km(points: DataFrame, edges: DataFrame, lon: str, lat: str, paired: bool = False) -> DataFrame:
    """(lon, lat, region_id, dist_km) with 0 inside a region.

    ``paired`` says that ``points`` already names the region of each row in a
    region_id column; without it every place meets every region.
    """
    key = [lon, lat, "region_id"]
    if paired:
        near = nearest(points, edges, match=["region_id"], lon=lon, lat=lat)
    else:
        near = nearest(points, edges, by=["region_id"], lon=lon, lat=lat)
    inside = point_in_polygon(points.select(lon, lat), edges, lon, lat).select(
        *key, F.lit(0.0).alias("_in")).distinct()
    both = near.join(inside, key, "left")
    return both.select(*key, F.coalesce("_in", _km(F.col("_dist"))).alias("dist_km"))


def regional_distance(points: DataFrame, edges: DataFrame, id: str, lon: str = "LONGITUDE",
                      lat: str = "LATITUDE", max_dist: float | None = None) -> DataFrame:
    """Great circle distance (km) from each point to each region, 0 inside: (id, region_id, dist_km).

    Without ``max_dist`` every pair is returned: the table has points times
    regions rows by definition. With it a pair is returned if the point lies
    within ``max_dist / 65`` degrees of the region in the plane, and a point
    without any such region gets its distance to all regions.
    """
    rows = points.select(id, lon, lat)
    if max_dist is None:
        return rows.join(place_region_km(rows, edges, lon, lat), [lon, lat]).select(id, "region_id", "dist_km")
    degrees = max_dist / 65
    places = cut_lineage(rows.select(lon, lat).distinct())
    flat = nearest(places, edges, by=["region_id"], metric=geo.PLANE, limit=degrees, lon=lon, lat=lat)
    inside = point_in_polygon(places, edges, lon, lat).select(lon, lat, "region_id")
    close = cut_lineage(flat.select(lon, lat, "region_id").union(inside).distinct())
    near = place_region_km(close, edges, lon, lat, paired=True)
    far = place_region_km(places.join(close, [lon, lat], "left_anti"), edges, lon, lat)
    return rows.join(near.unionByName(far), [lon, lat]).select(id, "region_id", "dist_km")


def distances_within(points: DataFrame, edges: DataFrame, id: str, km: float, lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """(id, region_id, dist_km) of the points and regions that are ``km`` or less apart, 0 inside; no others are built."""
    rows = points.select(id, lon, lat)
    key = [lon, lat, "region_id"]
    near = nearest(rows, edges, by=["region_id"], limit=km_to_chord(km), lon=lon, lat=lat).select(*key, _km(F.col("_dist")).alias("dist_km"))
    inside = point_in_polygon(rows, edges, lon, lat).select(*key).distinct()
    both = inside.withColumn("dist_km", F.lit(0.0)).unionByName(near.join(inside, key, "left_anti"))
    return rows.join(both, [lon, lat]).select(id, "region_id", "dist_km")


def distances_wide(distances: DataFrame, id: str, regions) -> DataFrame:
    """One row per point and one column per region."""
    return distances.groupBy(id).pivot("region_id", list(regions)).agg(F.min("dist_km"))


def nearest_region(points: DataFrame, edges: DataFrame, out: str = "region_id", match=(),
                   lon: str = "LONGITUDE", lat: str = "LATITUDE",
                   window_deg: float | None = None) -> DataFrame:
    """Add the containing region, else the nearest one (within the window), else null."""
    placed = cut_lineage(assign_region(points, edges, "_inside", lon, lat, match))
    lost = placed.where(F.col("_inside").isNull())
    limit = None
    if window_deg is not None:
        # The farthest corner of the window, so that far tiles are not even paired.
        limit = km_to_chord(math.radians(window_deg * 1.5) * geo.POLYGON_RADIUS_KM * 1.01)
    close = nearest(lost, edges, carry=["region_id"], match=match, limit=limit,
                    window_deg=window_deg, lon=lon, lat=lat)
    close = close.select(lon, lat, *match, F.col("region_id").alias("_close"))
    return (placed.join(close, [lon, lat, *match], "left")
            .withColumn(out, F.coalesce("_inside", "_close")).select(*points.columns, out))


def within_degrees(points: DataFrame, edges: DataFrame, degrees: float,
                   lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Points inside a polygon or within so many degrees of one in the plane."""
    near = nearest(points, edges, metric=geo.PLANE, limit=degrees, lon=lon, lat=lat).select(lon, lat)
    inside = point_in_polygon(points, edges, lon, lat).select(lon, lat)
    return points.join(near.union(inside).distinct(), [lon, lat], "left_semi").select(*points.columns)


def distance_to_layers_m(points: DataFrame, layers: DataFrame, out: str = "dist2coast",
                         lon: str = "LONGITUDE", lat: str = "LATITUDE") -> DataFrame:
    """Metres to the nearest edge of any of the layers."""
    d = nearest(points, layers, lon=lon, lat=lat)
    return (points.join(d, [lon, lat], "left")
            .withColumn(out, _km(F.col("_dist")) * 1000).select(*points.columns, out))
