"""Distances on a sphere and in the longitude-latitude plane as Column expressions.

A place is a 3-vector: a unit vector on the sphere, or (longitude, latitude, 0)
in the plane. Straight-line distance between vectors obeys the triangle
inequality in both, which is all the pruning in the spatial joins needs; the
great circle distance is recovered from the chord at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Earth radii in km, for station pairs and for polygon distances.
PAIR_RADIUS_KM = 6378.388
POLYGON_RADIUS_KM = 6371.01

SPHERE, PLANE = "sphere", "plane"


def vector(lon: Column, lat: Column, metric: str = SPHERE) -> list[Column]:
    if metric == PLANE:
        return [lon.cast("double"), lat.cast("double"), F.lit(0.0)]
    lam, phi = F.radians(lon), F.radians(lat)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def add_vector(df: DataFrame, prefix: str, lon, lat, metric: str = SPHERE) -> DataFrame:
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    return df.withColumns(dict(zip([f"{prefix}{c}" for c in "xyz"], vector(lon, lat, metric))))


def cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def chord(a, b) -> Column:
    d = [p - q for p, q in zip(a, b)]
    return F.sqrt(dot(d, d))


def chord_to_km(c: Column, radius: float) -> Column:
    return 2 * radius * F.asin(F.least(c / 2, F.lit(1.0)))


def great_circle_km(lon1, lat1, lon2, lat2, radius: float = PAIR_RADIUS_KM) -> Column:
    a = vector(*(F.col(c) if isinstance(c, str) else c for c in (lon1, lat1)))
    b = vector(*(F.col(c) if isinstance(c, str) else c for c in (lon2, lat2)))
    return chord_to_km(chord(a, b), radius)


def prepare_segments(edges: DataFrame, metric: str = SPHERE) -> DataFrame:
    """Add the vectors of each edge (x1, y1)-(x2, y2) that point distances need."""
    e = add_vector(add_vector(edges, "a", "x1", "y1", metric), "b", "x2", "y2", metric)
    a, b = cols("a"), cols("b")
    if metric == PLANE:
        return e
    e = e.withColumns(dict(zip(("nx", "ny", "nz"), cross(a, b))))
    n = cols("n")
    e = e.withColumns({**dict(zip(("tx", "ty", "tz"), cross(n, a))),
                       **dict(zip(("ux", "uy", "uz"), cross(b, n)))})
    return e.withColumn("nn", F.sqrt(dot(n, n)))


def segment_distance(p, metric: str = SPHERE) -> Column:
    """Straight-line distance from place ``p`` to the nearest point of a prepared edge."""
    a, b = cols("a"), cols("b")
    ends = F.least(chord(p, a), chord(p, b))
    if metric == PLANE:
        ab = [q - r for q, r in zip(b, a)]
        along = F.try_divide(dot([q - r for q, r in zip(p, a)], ab), dot(ab, ab))
        foot = [q + along * s for q, s in zip(a, ab)]
        return F.when((along > 0) & (along < 1), chord(p, foot)).otherwise(ends)
    beside = (F.col("nn") > 1e-15) & (dot(cols("t"), p) > 0) & (dot(cols("u"), p) > 0)
    height = F.abs(F.try_divide(dot(cols("n"), p), F.col("nn")))
    # Angle = asin(height), so chord = 2 sin(asin(height) / 2).
    return F.when(beside, 2 * F.sin(F.asin(F.least(height, F.lit(1.0))) / 2)).otherwise(ends)
