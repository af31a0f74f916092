"""Close pairs, polygons, grids, clusters and regional models."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.functions import geodesy as geo
from firnline.functions.labels import cluster_label
from firnline.operators import cluster, correlation, grid, regional, rules, spatial
from firnline.operators.reshape import distance_class
from firnline.plans import climate, enrichment, pairs as pair_plan
from firnline.registry.base import big, query, rnd
from firnline.registry.sqltext import (IN_RECTANGLE, RECTANGLES, haversine_sql, linkage_ctes, recursive,
                                       sphere_distance_ctes, with_views)
from firnline.session import cut_lineage


def regions(cat):
    return cat.rectangles(RECTANGLES)


# --- pairs --------------------------------------------------------------------------

PAIRS = f"""SELECT a.ID AS ID1, b.ID AS ID2, (a.LONGITUDE + b.LONGITUDE) / 2 AS AVE_LON,
  (a.LATITUDE + b.LATITUDE) / 2 AS AVE_LAT, (a.ELEVATION + b.ELEVATION) / 2 AS AVE_ELEV,
  {haversine_sql('a.LONGITUDE', 'a.LATITUDE', 'b.LONGITUDE', 'b.LATITUDE')} AS DIST,
  abs(a.ELEVATION - b.ELEVATION) AS DELEV FROM {{t}} a JOIN {{t}} b ON a.ID < b.ID"""


@query("j9_close_pairs", with_views("""
SELECT ID1, ID2, round(AVE_LON, 6) AS AVE_LON, round(AVE_LAT, 6) AS AVE_LAT, AVE_ELEV, round(DIST, 5) AS DIST, DELEV
FROM pairs WHERE DIST <= 120 AND DELEV <= 1200""", "places", pairs=PAIRS.format(t="places")))
def j9(cat):
    return spatial.close_pairs(cat.places, 120, 1200).select(
        "ID1", "ID2", rnd("AVE_LON").alias("AVE_LON"), rnd("AVE_LAT").alias("AVE_LAT"), "AVE_ELEV",
        rnd("DIST", 5).alias("DIST"), "DELEV")


@query("k4_dissimilarity_pairs", with_views("""
SELECT ID1, ID2, round(DIST / 40 + DELEV / 400, 6) AS SCORE FROM pairs WHERE DIST / 40 + DELEV / 400 <= 2""",
                                            "places", pairs=PAIRS.format(t="places")))
def k4(cat):
    return spatial.dissimilarity_pairs(cat.places, 40, 400, 2).select("ID1", "ID2", rnd("SCORE").alias("SCORE"))


STUDY = {
    "pairs": PAIRS.format(t="stations"),
    "close": "SELECT * FROM pairs WHERE DIST <= 600 AND DELEV <= 900",
    "met": """SELECT close.*, a.ELEMENT, a.VALUE AS VA, b.VALUE AS VB FROM close JOIN obs a ON a.ID = ID1
      JOIN obs b ON b.ID = ID2 AND a.DATE = b.DATE AND a.ELEMENT = b.ELEMENT WHERE a.VALUE <> 0 AND b.VALUE <> 0""",
    "study": """SELECT ID1, ID2, ELEMENT, DIST, DELEV, count(*) AS N,
      covar_pop(VA, VB) / nullif(stddev_pop(VA) * stddev_pop(VB), 0) AS pcorr FROM met GROUP BY ALL""",
}


@query("j10_pair_correlation", with_views("""
SELECT ID1, ID2, ELEMENT, round(DIST, 4) AS DIST, N, round(pcorr, 6) AS pcorr FROM study WHERE pcorr IS NOT NULL""",
                                          "stations", "obs", **STUDY))
def j10(cat):
    pairs = spatial.close_pairs(cat.stations, 600, 900).select("ID1", "ID2", "DIST")
    return correlation.pair_correlation(pairs, cat.obs, places=cat.stations).select(
        "ID1", "ID2", "ELEMENT", rnd("DIST", 4).alias("DIST"), "N", rnd("pcorr").alias("pcorr"))


@query("p8_close_pair_study", with_views("""
SELECT ELEMENT, distcut, count(*) AS PAIRS, round(avg(pcorr), 6) AS MEAN_CORR FROM (SELECT *, CASE
  WHEN DIST > 0 AND DIST <= 2.5 THEN '(0,2.5]' WHEN DIST > 2.5 AND DIST <= 5 THEN '(2.5,5]'
  WHEN DIST > 5 AND DIST <= 10 THEN '(5,10]' WHEN DIST > 10 AND DIST <= 20 THEN '(10,20]'
  WHEN DIST > 20 AND DIST <= 30 THEN '(20,30]' END AS distcut FROM (
    SELECT * REPLACE (DIST / 20 AS DIST) FROM study WHERE pcorr IS NOT NULL AND N >= 3)) WHERE distcut IS NOT NULL GROUP BY ALL""",
                                         "stations", "obs", **STUDY))
def p8(cat):
    # The stations of the test tables lie far apart, so distances are classed in units of 20 km.
    pairs = spatial.close_pairs(cat.stations, 600, 900).select("ID1", "ID2", (F.col("DIST") / 20).alias("DIST"))
    study = correlation.classed(correlation.pair_correlation(pairs, cat.obs, places=cat.stations), 3)
    return study.groupBy("ELEMENT", "distcut").agg(F.count(F.lit(1)).alias("PAIRS"),
                                                   rnd(F.avg("pcorr")).alias("MEAN_CORR"))


@query("a11_grouped_correlation", with_views("""
SELECT ID, ELEMENT, count(*) AS N, round(covar_pop(VALUE, day(DATE)) / (stddev_pop(VALUE) * stddev_pop(day(DATE))), 6) AS pcorr
FROM obs GROUP BY ALL HAVING count(*) >= 30""", "obs"))
def a11(cat):
    d = F.dayofmonth("DATE")
    stats = cat.obs.groupBy("ID", "ELEMENT").agg(F.count(F.lit(1)).alias("N"), rnd(F.corr("VALUE", d)).alias("pcorr"))
    return stats.where(F.col("N") >= 30)


@query("c13_distance_classes", with_views("""
SELECT CASE WHEN d > 0 AND d <= 2.5 THEN '(0,2.5]' WHEN d > 2.5 AND d <= 5 THEN '(2.5,5]' WHEN d > 5 AND d <= 10 THEN '(5,10]'
  WHEN d > 10 AND d <= 20 THEN '(10,20]' WHEN d > 20 AND d <= 30 THEN '(20,30]' END AS distcut, count(*) AS N
FROM (SELECT VALUE / 2 AS d FROM obs) GROUP BY 1 HAVING distcut IS NOT NULL""", "obs"))
def c13(cat):
    classed = cat.obs.select(distance_class(F.col("VALUE") / 2).alias("distcut")).where(F.col("distcut").isNotNull())
    return classed.groupBy("distcut").agg(F.count(F.lit(1)).alias("N"))


# --- polygons ------------------------------------------------------------------------

@query("j11_point_in_polygon", with_views(f"""
SELECT ID, region_id FROM places JOIN regions ON {IN_RECTANGLE}""", "places", "regions"))
def j11(cat):
    inside = spatial.point_in_polygon(cat.places, regions(cat))
    return cat.places.join(inside, ["LONGITUDE", "LATITUDE"]).select("ID", "region_id")


BOXES = """SELECT STATE AS region_id, min(LONGITUDE) AS x0, min(LATITUDE) AS y0, max(LONGITUDE) AS x1, max(LATITUDE) AS y1
  FROM stations GROUP BY STATE HAVING max(LONGITUDE) > min(LONGITUDE) AND max(LATITUDE) > min(LATITUDE)"""


def state_boxes(cat):
    """One overlapping polygon per state, from the stations themselves."""
    from firnline.sources.tables import polygon_edges
    b = cat.stations.groupBy("STATE").agg(F.min("LONGITUDE").alias("w"), F.min("LATITUDE").alias("s"),
                                          F.max("LONGITUDE").alias("e"), F.max("LATITUDE").alias("n"))
    b = b.where((F.col("e") > F.col("w")) & (F.col("n") > F.col("s")))
    corner = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in
              (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"))]
    return polygon_edges(b.select(F.col("STATE").alias("region_id"), F.lit(1).alias("poly_id"),
                                  F.lit(1).alias("ring_id"), F.array(*corner).alias("points")))


@query("j11_overlapping_polygons", with_views(f"""
SELECT p.ID, region_id FROM places p JOIN boxes ON {IN_RECTANGLE}""", "places", "stations", boxes=BOXES))
def j11_overlap(cat):
    inside = spatial.point_in_polygon(cat.places, state_boxes(cat))
    return cat.places.join(inside, ["LONGITUDE", "LATITUDE"]).select("ID", "region_id")


@query("j12_nearest_region", with_views(f"""
SELECT ID, coalesce(r.region_id, n.region_id) AS REGION FROM places LEFT JOIN regions r ON {IN_RECTANGLE}
LEFT JOIN (SELECT ID, first(region_id ORDER BY km, region_id) AS region_id FROM near GROUP BY ID) n USING (ID)""",
                                        "places", "regions", "edges", **sphere_distance_ctes("places", "edges", "ID")))
def j12(cat):
    return spatial.nearest_region(cat.places, regions(cat), "REGION").select("ID", "REGION")


COUNTY_STRIPS = """SELECT STATE, 'C' || i AS region_id, CAST(-125 + 15 * i AS DOUBLE) AS x0, CAST(33 AS DOUBLE) AS y0,
  CAST(-110 + 15 * i AS DOUBLE) AS x1, CAST(46 AS DOUBLE) AS y1 FROM (SELECT DISTINCT STATE FROM stations), (VALUES (0), (1), (2), (3)) t(i)"""


def county_strips(cat):
    """Four counties per state, side by side, between 33 and 46 degrees."""
    from firnline.sources.tables import polygon_edges
    states = cat.table("nation").select(F.col("n_name").alias("STATE"))
    strips = states.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "STATE", F.concat(F.lit("C"), "i").alias("region_id"), (-125 + 15.0 * F.col("i")).alias("w"),
        (-110 + 15.0 * F.col("i")).alias("e"))
    corner = [F.struct(F.col(x).alias("x"), F.lit(y).alias("y")) for x, y in
              (("w", 33.0), ("e", 33.0), ("e", 46.0), ("w", 46.0))]
    rings = strips.select(F.concat_ws("|", "STATE", "region_id").alias("region_id"), F.lit(1).alias("poly_id"),
                          F.lit(1).alias("ring_id"), F.array(*corner).alias("points"))
    e = polygon_edges(rings).withColumn("_p", F.split("region_id", "\\|"))
    return e.withColumns({"STATE": F.col("_p")[0], "region_id": F.col("_p")[1]}).drop("_p")


@query("j12_county_in_state", with_views(f"""
SELECT s.ID, coalesce(c.region_id, n.region_id) AS COUNTY FROM stations s
LEFT JOIN strips c ON s.STATE = c.STATE AND {IN_RECTANGLE}
LEFT JOIN (SELECT ID, first(region_id ORDER BY km, region_id) AS region_id FROM near GROUP BY ID) n ON s.ID = n.ID""",
                                         "stations", strips=COUNTY_STRIPS,
                                         sedges="""SELECT STATE, region_id, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM strips
    UNION ALL SELECT STATE, region_id, x1, y0, x1, y1 FROM strips UNION ALL SELECT STATE, region_id, x1, y1, x0, y1 FROM strips
    UNION ALL SELECT STATE, region_id, x0, y1, x0, y0 FROM strips""",
                                         **sphere_distance_ctes("stations", "sedges", "ID", on="pv.STATE = en.STATE")))
def j12_county(cat):
    return enrichment.add_county(cat.stations.drop("COUNTY"), county_strips(cat)).select("ID", "COUNTY")


@query("j13_within_degrees", with_views("""
SELECT DISTINCT ID FROM places, regions WHERE sqrt(pow(greatest(x0 - LONGITUDE, LONGITUDE - x1, 0), 2)
  + pow(greatest(y0 - LATITUDE, LATITUDE - y1, 0), 2)) <= 2""", "places", "regions"))
def j13(cat):
    return spatial.within_degrees(cat.places, regions(cat), 2).select("ID")


IN_OR_NEAR = f"""SELECT n.ID, n.region_id, CASE WHEN {IN_RECTANGLE} THEN 0 ELSE km END AS km
  FROM near n JOIN {{points}} USING (ID) JOIN regions r ON n.region_id = r.region_id"""


def _distance_views(points):
    return {**sphere_distance_ctes(points, "edges", "ID"), "dist": IN_OR_NEAR.format(points=points)}


@query("j14_regional_distance", with_views("SELECT ID, region_id, round(km, 5) AS DIST_KM FROM dist",
                                           "places", "regions", "edges", **_distance_views("places")))
def j14(cat):
    return spatial.regional_distance(cat.places, regions(cat), "ID").select(
        "ID", "region_id", rnd("dist_km", 5).alias("DIST_KM"))


@query("j15_buffered_distance", with_views(f"""
SELECT d.ID, d.region_id, round(km, 5) AS DIST_KM FROM dist d JOIN flat USING (ID, region_id)
WHERE deg <= 65 / 65.0 OR NOT EXISTS (SELECT 1 FROM flat f WHERE f.ID = d.ID AND f.deg <= 65 / 65.0)""",
                                           "places", "regions", "edges", **_distance_views("places"),
                                           flat="""SELECT ID, region_id, sqrt(pow(greatest(x0 - LONGITUDE, LONGITUDE - x1, 0), 2)
  + pow(greatest(y0 - LATITUDE, LATITUDE - y1, 0), 2)) AS deg FROM places, regions"""))
def j15(cat):
    return spatial.regional_distance(cat.places, regions(cat), "ID", max_dist=65).select(
        "ID", "region_id", rnd("dist_km", 5).alias("DIST_KM"))


@query("j16_nearest_rows", with_views("""
SELECT region_id, ID FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY km, ID) AS k FROM dist) WHERE k <= 12""",
                                      "places", "regions", "edges", **_distance_views("places")))
def j16(cat):
    return regional.training_rows(cat.places, regions(cat), "ID", 0, 12, need_inside=False).select("region_id", "ID")


@query("h3_distances_wide", with_views("""
SELECT ID, round(max(CASE WHEN region_id = 'A' THEN km END), 5) AS A, round(max(CASE WHEN region_id = 'B' THEN km END), 5) AS B,
  round(max(CASE WHEN region_id = 'C' THEN km END), 5) AS C, round(max(CASE WHEN region_id = 'D' THEN km END), 5) AS D
FROM dist GROUP BY ID""", "stations", "regions", "edges", **_distance_views("stations")))
def h3(cat):
    wide = spatial.distances_wide(spatial.regional_distance(cat.stations, regions(cat), "ID"), "ID", "ABCD")
    return wide.select("ID", *[rnd(c, 5).alias(c) for c in "ABCD"])


# Areas that make A the mainland, B a large lake, C a small lake, D an island.
LAYER_AREAS = {"A": 2e7, "B": 30000.0, "C": 100.0, "D": 5e6}


@query("j21_distance_to_coast", with_views("""
SELECT ID, round(1000 * min(km), 2) AS DIST2COAST FROM near WHERE region_id IN ('A', 'B', 'D') GROUP BY ID""",
                                           "places", "regions", "edges", **sphere_distance_ctes("places", "edges", "ID")))
def j21(cat):
    area = F.create_map(*[e for k, v in LAYER_AREAS.items() for e in (F.lit(k), F.lit(v))])
    edges = regions(cat).withColumn("area", area[F.col("region_id")])
    layer = {k: edges.where(F.col("region_id").isin(*v)) for k, v in
             {"shores": ["A"], "lakes": ["B", "C"], "islands": ["D"]}.items()}
    return climate.distance_to_coast(cat.places, **layer).select("ID", rnd("dist2coast", 2).alias("DIST2COAST"))


@query("a12_largest_area", with_views("""
SELECT region_id, round(max((x1 - x0) * (y1 - y0)), 6) AS MAXAREA FROM boxes
WHERE (x1 - x0) * (y1 - y0) > (SELECT quantile_cont((x1 - x0) * (y1 - y0), 0.5) FROM boxes) GROUP BY region_id""",
                                      "stations", boxes=BOXES))
def a12(cat):
    edges = state_boxes(cat)
    areas = enrichment.polygon_area(edges)
    main = enrichment.main_polygons(edges, areas, 0.5)
    return enrichment.largest_area(enrichment.polygon_area(main)).select("region_id", rnd("maxarea").alias("MAXAREA"))


@query("p6_station_enrichment", with_views(f"""
SELECT s.ID, coalesce(f.region_id, n.region_id) AS ECO3, coalesce(m.region_id, n.region_id) AS ECO3_SIMP, round(x.mx * 25.4, 4) AS STATE_MAX,
  'C' || CAST(greatest(0, least(3, floor((LONGITUDE + 125) / 15))) AS INTEGER) AS COUNTY
FROM stations s LEFT JOIN regions f ON {IN_RECTANGLE.replace('x0', 'f.x0').replace('x1', 'f.x1').replace('y0', 'f.y0').replace('y1', 'f.y1')}
LEFT JOIN main m ON {IN_RECTANGLE.replace('x0', 'm.x0').replace('x1', 'm.x1').replace('y0', 'm.y0').replace('y1', 'm.y1')}
LEFT JOIN (SELECT ID, first(region_id ORDER BY km, region_id) AS region_id FROM near GROUP BY ID) n ON s.ID = n.ID
LEFT JOIN (SELECT n_name AS STATE, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS mx FROM nation) x ON s.STATE = x.STATE
WHERE f.region_id IS NOT NULL OR EXISTS (SELECT 1 FROM main r WHERE sqrt(pow(greatest(r.x0 - LONGITUDE, LONGITUDE - r.x1, 0), 2)
  + pow(greatest(r.y0 - LATITUDE, LATITUDE - r.y1, 0), 2)) <= 2)""", "stations", "regions", "edges",
                                           main="SELECT * FROM regions WHERE region_id <> 'D'",
                                           medges="SELECT * FROM edges WHERE region_id <> 'D'",
                                           **sphere_distance_ctes(
                                               "stations", "medges", "ID", on="""greatest(x1, x2) >= LONGITUDE - 3
  AND least(x1, x2) <= LONGITUDE + 3 AND greatest(y1, y2) >= LATITUDE - 3 AND least(y1, y2) <= LATITUDE + 3""")))
def p6(cat):
    edges = regions(cat)
    simple = edges.where(F.col("region_id") != "D")
    base = cat.stations.drop("ECO3", "STATE_MAX", "COUNTY")
    names = {r.n_name.title(): r.n_name for r in cat.table("nation").select("n_name").collect()}
    records = cat.table("nation").select(
        F.lower("n_name").alias("State"), F.lit(enrichment.SNOW_DEPTH_RECORD).alias("Element"),
        (F.col("n_nationkey") % 7 + 1).cast("string").alias("Notes"))
    placed = enrichment.add_ecoregion(rules.known_location(base), edges, simple)
    out = enrichment.add_state_max(placed, enrichment.state_records(records, names))
    out = enrichment.add_county(out, county_strips(cat))
    return out.select("ID", "ECO3", F.col("ECO3_simp").alias("ECO3_SIMP"), rnd("STATE_MAX", 4).alias("STATE_MAX"), "COUNTY")


# --- grids -----------------------------------------------------------------------------

VARS = ["PPTWT", "TD", "MAT"]
CELL = """SELECT p.*, floor((LATITUDE - gy) / dy) AS r, floor((LONGITUDE - gx) / dx) AS c,
  (LATITUDE - gy) / dy - floor((LATITUDE - gy) / dy) AS u, (LONGITUDE - gx) / dx - floor((LONGITUDE - gx) / dx) AS t
  FROM {points} p, spec"""


def bilinear_sql(points="places", grid="grid", variables=("PPTWT", "TD", "MAT")):
    mix = ", ".join(f"""(g00.{v} * (1 - t) + g01.{v} * t) * (1 - u) + (g10.{v} * (1 - t) + g11.{v} * t) * u AS {v}"""
                    for v in variables)
    joins = " ".join(f"LEFT JOIN {grid} g{i}{j} ON g{i}{j}.row = r + {i} AND g{i}{j}.col = c + {j}"
                     for i in (0, 1) for j in (0, 1))
    return f"SELECT ID, LONGITUDE, LATITUDE, {mix} FROM ({CELL.format(points=points)}) {joins}"


@query("j17_bilinear_sample", with_views("""
SELECT ID, round(PPTWT, 5) AS PPTWT, round(TD, 5) AS TD, round(MAT, 5) AS MAT FROM sampled""",
                                         "places", "grid", "spec", sampled=bilinear_sql()))
def j17(cat):
    return grid.bilinear(cat.places, cat.grid, cat.grid_spec(), VARS).select("ID", *[rnd(v, 5).alias(v) for v in VARS])


@query("j18_cell_sample", with_views("""
SELECT ID, PPTWT, TD FROM places, spec LEFT JOIN grid ON row = floor((LATITUDE - gy) / dy + 0.5) AND col = floor((LONGITUDE - gx) / dx + 0.5)""",
                                     "places", "grid", "spec"))
def j18(cat):
    return grid.cell_sample(cat.places, cat.grid, cat.grid_spec(), ["PPTWT", "TD"]).select("ID", "PPTWT", "TD")


@query("j19_nearest_cell", with_views(f"""
SELECT ID, first(TD ORDER BY d, row, col) AS TD FROM (SELECT ID, row, col, TD,
  round({haversine_sql('LONGITUDE', 'LATITUDE', 'x', 'y')}, 7) AS d FROM places, grid) GROUP BY ID""", "places", "grid"))
def j19(cat):
    return grid.nearest_cell(cat.places, cat.grid, ["TD"]).select("ID", "TD")


@query("j20_radius_means", with_views(f"""
SELECT ID, round(coalesce(avg(CASE WHEN d <= 30 THEN PPTWT END), avg(CASE WHEN d <= 60 THEN PPTWT END), avg(CASE WHEN d <= 150 THEN PPTWT END)), 5) AS PPTWT
FROM places LEFT JOIN (SELECT ID, PPTWT, {haversine_sql('LONGITUDE', 'LATITUDE', 'x', 'y')} AS d FROM places, grid) USING (ID) GROUP BY ID""",
                                      "places", "grid"))
def j20(cat):
    return grid.radius_means(cat.places, cat.grid, ["PPTWT"], [30000, 60000, 150000]).select(
        "ID", rnd("PPTWT", 5).alias("PPTWT"))


@query("a14_coarse_grid", with_views("""
SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, round(avg(PPTWT), 5) AS PPTWT, round(avg(TD), 5) AS TD
FROM grid GROUP BY 1, 2""", "grid"))
def a14(cat):
    return grid.coarsen(cat.grid, 4, ["PPTWT", "TD"]).select("row", "col", rnd("PPTWT", 5).alias("PPTWT"), rnd("TD", 5).alias("TD"))


@query("p7_climate_cascade", with_views(f"""
SELECT s.ID, round(CASE WHEN s.PPTWT IS NOT NULL THEN s.TD WHEN b.PPTWT IS NOT NULL THEN b.TD ELSE n.TD END, 5) AS TD
FROM sampled s JOIN second b USING (ID) JOIN (SELECT ID, first(TD ORDER BY d, row, col) AS TD FROM (
  SELECT ID, row, col, TD, round({haversine_sql('LONGITUDE', 'LATITUDE', 'x', 'y')}, 7) AS d FROM places, grid) GROUP BY ID) n USING (ID)""",
                                        "places", "grid", "spec", sampled=bilinear_sql(),
                                        cold="SELECT * REPLACE (CASE WHEN TD >= 4 THEN PPTWT END AS PPTWT) FROM (SELECT * REPLACE (TD * 100 AS PPTWT) FROM grid)",
                                        second=bilinear_sql(grid="cold")))
def p7(cat):
    g, spec = cat.grid, cat.grid_spec()
    cold = g.withColumn("PPTWT", F.when(F.col("TD") >= 4, F.col("TD") * 100))
    out = climate.covariates(cat.places, (g, spec), (cold, spec), (cold, spec), g, VARS)
    return out.select("ID", rnd("TD", 5).alias("TD"))


@query("p7_widening_sample", with_views(f"""
SELECT ID, round(coalesce(cell.PPTWT, w.m), 5) AS PPTWT FROM (
  SELECT ID, PPTWT FROM places, spec LEFT JOIN grid ON row = floor((LATITUDE - gy) / dy + 0.5) AND col = floor((LONGITUDE - gx) / dx + 0.5)) cell
JOIN (SELECT ID, coalesce(avg(CASE WHEN d <= 100 THEN PPTWT END), avg(CASE WHEN d <= 200 THEN PPTWT END)) AS m
  FROM places LEFT JOIN (SELECT ID, PPTWT, {haversine_sql('LONGITUDE', 'LATITUDE', 'x', 'y')} AS d FROM places, grid) USING (ID) GROUP BY ID) w
USING (ID)""", "places", "grid", "spec"))
def p7_widening(cat):
    out = climate.widening_sample(cat.places, cat.grid, cat.grid_spec(), ["PPTWT"], [100000, 200000], key="PPTWT")
    return out.select("ID", rnd("PPTWT", 5).alias("PPTWT"))


# --- clusters ----------------------------------------------------------------------------

SINGLE = f"""RECURSIVE places AS ({{places}}), link AS (
  SELECT a.ID AS a, b.ID AS b FROM places a, places b WHERE {haversine_sql('a.LONGITUDE', 'a.LATITUDE', 'b.LONGITUDE', 'b.LATITUDE')} / 30
    + abs(a.ELEVATION - b.ELEVATION) / 300 <= 2),
reach(ID, low) AS (SELECT ID, ID FROM places UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.ID WHERE reach.low < link.b)
SELECT ID, CAST(dense_rank() OVER (ORDER BY low) AS INTEGER) AS CLUST FROM (SELECT ID, min(low) AS low FROM reach GROUP BY ID)"""


@query("k1_cluster_single", "WITH " + SINGLE.format(
    places=__import__("firnline.registry.sqltext", fromlist=["PLACES"]).PLACES))
def k1_single(cat):
    return cluster.cluster_stations(cat.places, 30, 300, 2, "single").select("ID", "CLUST")


def linkage_check(method: str) -> str:
    return recursive(with_views("SELECT ID, CAST(CLUST AS INTEGER) AS CLUST FROM clustered", "places",
                                **linkage_ctes(method, 40, 400, 2, "places")))


@query("k1_cluster_complete", linkage_check("complete"))
def k1_complete(cat):
    return cluster.cluster_stations(cat.places, 40, 400, 2, "complete").select("ID", "CLUST")


@query("k1_complete_properties", with_views("""
SELECT 'stations' AS PROPERTY, count(*) AS N FROM places UNION ALL SELECT 'wide clusters', 0 UNION ALL SELECT 'mergeable clusters', 0""", "places"))
def k1_properties(cat):
    """Complete linkage by its properties: no pair of a cluster beyond the cut, no two clusters within it."""
    found = cluster.cluster_stations(cat.places, 40, 400, 2, "complete")
    sizes = found.groupBy("CLUST").agg(F.count(F.lit(1)).alias("n"))
    close = spatial.dissimilarity_pairs(cat.places, 40, 400, 2)
    of = found.select("ID", "CLUST")
    met = (close.join(of.withColumnsRenamed({"ID": "ID1", "CLUST": "C1"}), "ID1").join(of.withColumnsRenamed({"ID": "ID2", "CLUST": "C2"}), "ID2")
           .groupBy(F.least("C1", "C2").alias("A"), F.greatest("C1", "C2").alias("B")).agg(F.count(F.lit(1)).alias("m")))
    whole = met.join(sizes.withColumnsRenamed({"CLUST": "A", "n": "na"}), "A").join(sizes.withColumnsRenamed({"CLUST": "B", "n": "nb"}), "B")
    inside = met.where("A = B").select(F.col("A").alias("CLUST"), "m")
    wide = sizes.join(inside, "CLUST", "left").where(F.coalesce("m", F.lit(0)) != F.col("n") * (F.col("n") - 1) / 2)
    merge = whole.where((F.col("A") != F.col("B")) & (F.col("m") == F.col("na") * F.col("nb")))
    counts = [df.agg(F.lit(name).alias("PROPERTY"), F.count(F.lit(1)).alias("N")) for name, df in (
        ("stations", found), ("wide clusters", wide), ("mergeable clusters", merge))]
    return counts[0].union(counts[1]).union(counts[2])


def _linkage(name, method):
    @query(name, linkage_check(method))
    def run(cat):
        return cluster.cluster_stations(cat.places, 40, 400, 2, method).select("ID", "CLUST")


for _m in ("average", "mcquitty", "ward.D", "ward.D2"):
    _linkage("k2_cluster_" + _m.lower().replace(".", "_"), _m)


LABEL = "G || '.' || lpad(CAST(CLUST AS VARCHAR), 4, '0')"


@query("k3_cluster_in_regions", recursive(with_views(f"SELECT ID, G AS ECO3, {LABEL} AS CLUST FROM clustered", "stations",
                                                     **linkage_ctes("complete", 40, 400, 4, "stations", "ECO3"))))
def k3(cat):
    return cluster.cluster_stations(cat.stations, 40, 400, 4, group="ECO3", label=True).select("ID", "ECO3", "CLUST")


@query("c11_cluster_label", with_views("""
SELECT ID, ECO3 || '.' || lpad(CAST(row_number() OVER (PARTITION BY ECO3 ORDER BY ID) AS VARCHAR), 4, '0') AS CLUST FROM stations""",
                                       "stations"))
def c11(cat):
    # A cut at zero height leaves every station on its own.
    return cluster.cluster_stations(cat.stations, 1, 1, 0, group="ECO3").select(
        "ID", cluster_label("ECO3", "CLUST").alias("CLUST"))


# --- regional models ----------------------------------------------------------------------

MODEL_VIEWS = {
    **_distance_views("places"),
    "counts": "SELECT region_id, sum(CASE WHEN km < 150 THEN 1 ELSE 0 END) AS n FROM dist GROUP BY region_id HAVING min(km) = 0",
    "members": """SELECT region_id, ID FROM (SELECT d.*, n, row_number() OVER (PARTITION BY region_id ORDER BY km, ID) AS k
        FROM dist d JOIN counts USING (region_id)) WHERE CASE WHEN n >= 400 THEN km < 150 ELSE k <= 400 END""",
    "models": """SELECT region_id, count(*) AS n, regr_slope(VALUE, ELEVATION) AS b, regr_intercept(VALUE, ELEVATION) AS a
        FROM members JOIN places USING (ID) GROUP BY region_id""",
    "capped": "SELECT d.*, min(km) OVER (PARTITION BY ID) AS mk FROM dist d JOIN models USING (region_id)",
    "scored": """SELECT ID, region_id, pow((120 - CASE WHEN km >= 120 AND km = mk THEN 0 ELSE km END) / 120, 2) AS w
        FROM capped WHERE km < 120 OR km = mk""",
}


def _distances(cat):
    """Written once: membership and blending read it several times."""
    return cut_lineage(spatial.regional_distance(cat.places, regions(cat), "ID"))


@query("r1_region_members", with_views("SELECT region_id, ID FROM members", "places", "regions", "edges", **MODEL_VIEWS))
def r1_members(cat):
    return regional.training_rows(cat.places, regions(cat), "ID", 150, 400).select("region_id", "ID")


def _models(cat):
    d = _distances(cat)
    return d, regional.linear_models(cat.places, regional.membership(d, "ID", 150, 400), "ID", "VALUE", ["ELEVATION"])


@query("r1_linear_models", with_views("""
SELECT region_id, n AS N_TRAIN, round(a, 5) AS INTERCEPT, round(b, 7) AS SLOPE FROM models""",
                                      "places", "regions", "edges", **MODEL_VIEWS))
def r1_linear(cat):
    return _models(cat)[1].select("region_id", F.col("n_train").alias("N_TRAIN"), rnd(F.col("coef")[0], 5).alias("INTERCEPT"),
                                  rnd(F.col("coef")[1], 7).alias("SLOPE"))


@query("r2_blended_prediction", with_views("""
SELECT ID, round(sum(w * (a + b * ELEVATION)) / sum(w), 5) AS PREDICTION FROM scored JOIN models USING (region_id)
JOIN places USING (ID) GROUP BY ID""", "places", "regions", "edges", **MODEL_VIEWS))
def r2(cat):
    d, models = _models(cat)
    return regional.predict_linear(cat.places, d, models, "ID", ["ELEVATION"], 120).select(
        "ID", rnd("prediction", 5).alias("PREDICTION"))


@query("r2_function_models", with_views("""
SELECT ID, round(sum(w * m) / sum(w), 5) AS PREDICTION FROM scored JOIN (
  SELECT region_id, median(VALUE) AS m FROM members JOIN places USING (ID) GROUP BY region_id) USING (region_id) GROUP BY ID""",
                                        "places", "regions", "edges", **MODEL_VIEWS))
def r2_function(cat):
    d = _distances(cat)
    members = regional.membership(d, "ID", {"A": 150, "B": 150, "C": 150, "D": 150}, 400)
    models = regional.mergeable_models(cat.places, members, "ID", regional.GroupMedian("VALUE"))
    out = regional.predict_function(cat.places, d, models, "ID", lambda m, rows: [m] * len(rows), 120)
    return out.select("ID", rnd("prediction", 5).alias("PREDICTION"))
