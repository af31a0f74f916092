"""Daily loads and the end-to-end analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.functions import loads as conv
from firnline.operators import loads, reshape
from firnline.plans import loads as load_plan
from firnline.plans import station
from firnline.registry.base import day, query, rnd
from firnline.operators.fitting import LOAD_COLUMNS
from firnline.registry.fits import LNORM_LEVEL, SUMMARY, YM, load_summary_views, sparse_maxima
from firnline.registry.observations import high_max_sql, monthly_sql, yearly_sql
from firnline.registry.sqltext import IN_RECTANGLE, RECTANGLES, ROW_RULES, linkage_ctes, qnorm_sql, recursive, with_views, wy

FIRST, LAST = 1996, 2000
CLASSES = [row[0] for row in conv.snow_class_rows()]


def grouped_stations(cat):
    """Stations with a cluster (their state) and a snow climate."""
    climate = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("ID") % 6 + 1).cast("int"))
    return cat.stations.withColumns({"cuID": F.col("STATE"), "climate": climate})


CLASS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {a!r}, {b!r}, {c!r}, {d!r})" for i, (n, a, b, c, d) in enumerate(conv.snow_class_rows())
) + ") t(i, climate, pmax, po, k1, k2)"

LOADS = {
    "classes": CLASS_SQL,
    "gst": "SELECT stations.*, STATE AS cuID, ID % 6 AS i FROM stations",
    "season": f"""SELECT o.ID, cuID, climate, pmax, po, k1, k2, DATE, ELEMENT, month(DATE) AS MONTH,
      CASE WHEN ELEMENT = 'SNWD' THEN VALUE * CAST(0.1 AS DOUBLE) ELSE VALUE * CAST(0.01 AS DOUBLE) END AS V, dayofyear(DATE) AS dd,
      year(DATE) + CASE WHEN month(DATE) < 9 THEN 0 ELSE 1 END AS wYEAR
      FROM obs o LEFT JOIN gst USING (ID) LEFT JOIN classes USING (i)
      WHERE coalesce(QFLAG, ' ') = ' ' AND coalesce(MFLAG, ' ') <> 'P' AND (month(DATE) < 6 OR month(DATE) > 9)""",
    "dated": f"""SELECT *, CASE WHEN dd > 250 THEN CASE WHEN dd = 366 THEN -1 ELSE dd - 366 END ELSE dd END AS DOYA
      FROM season WHERE wYEAR BETWEEN {FIRST} AND {LAST}""",
    "depth": """SELECT *, V * ((pmax - po) * (1 - exp(-k1 * V - k2 * DOYA)) + po) * CAST(0.09806665 AS DOUBLE) AS W1
      FROM dated WHERE ELEMENT = 'SNWD'""",
    "water": "SELECT *, V * CAST(0.09806665 AS DOUBLE) AS W3 FROM dated WHERE ELEMENT = 'WESD'",
    "joined": """SELECT coalesce(d.ID, w.ID) AS ID, coalesce(d.cuID, w.cuID) AS cuID, coalesce(d.DATE, w.DATE) AS DATE,
      coalesce(d.wYEAR, w.wYEAR) AS wYEAR, coalesce(d.MONTH, w.MONTH) AS MONTH, W1, W3
      FROM depth d FULL JOIN water w ON d.ID = w.ID AND d.DATE = w.DATE""",
    "daily": """SELECT * FROM (SELECT *, CASE WHEN W3 > 0 OR (W3 IS NOT NULL AND NOT coalesce(W1 > 0, false)) THEN W3 ELSE W1 END AS WEIGHT,
      CASE WHEN W3 > 0 OR (W3 IS NOT NULL AND NOT coalesce(W1 > 0, false)) THEN 1 ELSE 0 END AS direct FROM joined) WHERE WEIGHT >= 0""",
}


def season_sql(source: str, tag: str) -> dict[str, str]:
    return {
        f"{tag}rep": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cuID, DATE ORDER BY direct DESC, WEIGHT DESC, ID) AS r
          FROM {source}) WHERE r = 1""",
        f"{tag}max": f"""SELECT cuID, wYEAR, max(WEIGHT) AS maxW, count(*) AS nday, count(DISTINCT MONTH) AS nmonth,
          first(MONTH ORDER BY WEIGHT DESC, DATE) AS wmonth FROM {tag}rep GROUP BY ALL""",
        f"{tag}cov": f"""SELECT * FROM (SELECT *, median(maxW) OVER (PARTITION BY cuID) AS q50, quantile_cont(maxW, 0.1) OVER (PARTITION BY cuID) AS q10,
          quantile_cont(maxW, 0.25) OVER (PARTITION BY cuID) AS q25 FROM {tag}max) WHERE (nday >= 30 AND nmonth >= 5) OR maxW > q50""",
    }


OUTLIERS = {
    **season_sql("daily", "a"),
    "bounds": """SELECT cuID, exp(greatest(3 * (b - a) + b, 0.7871)) - 1 AS CUTOFF FROM (
      SELECT cuID, quantile_cont(ln(maxW + 1), 0.25) AS a, quantile_cont(ln(maxW + 1), 0.75) AS b FROM acov GROUP BY cuID)""",
    "above": "SELECT daily.*, CUTOFF, count(*) OVER (PARTITION BY cuID, wYEAR) AS n FROM daily JOIN bounds USING (cuID) WHERE WEIGHT > CUTOFF",
    "outl": "SELECT * FROM above WHERE n < 5",
}
FINAL = {
    "kept": "SELECT * FROM daily d WHERE NOT EXISTS (SELECT 1 FROM outl o WHERE o.cuID = d.cuID AND o.ID = d.ID AND o.DATE = d.DATE)",
    **season_sql("kept", "b"),
    "recs": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cuID) AS n FROM bcov) WHERE n > 3 AND (maxW > q10 OR q25 = 0)",
}


def _daily(cat):
    return load_plan.daily_loads(cat.obs, grouped_stations(cat), FIRST, LAST)


@query("c5_class_density_load", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, round(V, 6) AS DEPTH, round(W1, 7) AS LOAD FROM depth""", "obs", "stations", **LOADS))
def c5(cat):
    rows = loads.season_rows(cat.obs, FIRST, LAST).join(grouped_stations(cat).select("ID", "cuID", "climate"), "ID", "left")
    out = loads.depth_loads(rows, conv.snow_classes(cat.spark))
    return out.select("ID", day().alias("DAY"), rnd("SNWD").alias("DEPTH"), rnd("WEIGHT1", 7).alias("LOAD"))


@query("j5_depth_water_join", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, round(W1, 7) AS W1, round(W3, 7) AS W3 FROM joined""", "obs", "stations", **LOADS))
def j5(cat):
    rows = loads.season_rows(cat.obs, FIRST, LAST).join(grouped_stations(cat).select("ID", "cuID", "climate"), "ID", "left")
    both = loads.join_elements(loads.depth_loads(rows, conv.snow_classes(cat.spark)), loads.water_loads(rows))
    return both.select("ID", day().alias("DAY"), rnd("WEIGHT1", 7).alias("W1"), rnd("WEIGHT3", 7).alias("W3"))


@query("c9_weight_precedence", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, round(WEIGHT, 7) AS WEIGHT, direct AS DIRECT FROM daily""", "obs", "stations", **LOADS))
def c9(cat):
    return _daily(cat).select("ID", day().alias("DAY"), rnd("WEIGHT", 7).alias("WEIGHT"), F.col("direct").alias("DIRECT"))


@query("y5_daily_representative", with_views("""
SELECT cuID AS CLUSTER, strftime(DATE, '%Y-%m-%d') AS DAY, ID, round(WEIGHT, 7) AS WEIGHT, direct AS DIRECT FROM arep""",
                                            "obs", "stations", **LOADS, **season_sql("daily", "a")))
def y5(cat):
    return loads.daily_representative(_daily(cat)).select(
        F.col("cuID").alias("CLUSTER"), day().alias("DAY"), "ID", rnd("WEIGHT", 7).alias("WEIGHT"), F.col("direct").alias("DIRECT"))


@query("y4_season_coverage", with_views("""
SELECT cuID AS CLUSTER, wYEAR AS SEASON, round(maxW, 7) AS MAXW, nday AS NDAY, nmonth AS NMONTH, wmonth AS WMONTH,
  round(q50, 6) AS Q50, round(q10, 6) AS Q10, round(q25, 6) AS Q25 FROM acov""", "obs", "stations", **LOADS, **season_sql("daily", "a")))
def y4(cat):
    out = loads.covered(loads.season_maxima(loads.daily_representative(_daily(cat))))
    return out.select(F.col("cuID").alias("CLUSTER"), F.col("wYEAR").alias("SEASON"), rnd("maxW", 7).alias("MAXW"),
                      F.col("nday").alias("NDAY"), F.col("nmonth").alias("NMONTH"), F.col("wmonth").alias("WMONTH"),
                      rnd("q50").alias("Q50"), rnd("q10").alias("Q10"), rnd("q25").alias("Q25"))


@query("j7_few_outliers_join", with_views("""
SELECT cuID AS CLUSTER, ID, strftime(DATE, '%Y-%m-%d') AS DAY, round(WEIGHT, 6) AS WEIGHT, round(CUTOFF, 6) AS CUTOFF FROM outl""",
                                          "obs", "stations", **LOADS, **OUTLIERS))
def j7(cat):
    return load_plan.outliers_of(_daily(cat)).select(
        F.col("cuID").alias("CLUSTER"), "ID", day().alias("DAY"), rnd("WEIGHT").alias("WEIGHT"), rnd("CUTOFF").alias("CUTOFF"))


@query("a7_floored_cutoff", with_views("SELECT cuID AS CLUSTER, round(CUTOFF, 6) AS CUTOFF FROM bounds",
                                       "obs", "stations", **LOADS, **OUTLIERS))
def a7(cat):
    out = loads.outlier_bounds(loads.covered(loads.season_maxima(loads.daily_representative(_daily(cat)))))
    return out.select(F.col("cuID").alias("CLUSTER"), rnd("CUTOFF").alias("CUTOFF"))


LOAD_VIEWS, _LOAD_TABLE = load_summary_views(12)
# All load columns of each cluster.
FULL = {"ym": "SELECT cuID AS ID, maxW AS MAX FROM recs", **LOAD_VIEWS, "loadtab": _LOAD_TABLE.replace("SELECT ID,", "SELECT ID AS cuID,", 1)}
TABLE = f"""SELECT cuID, count(*) AS numMax, median(maxW) AS medMax, max(maxW) AS mMax,
  CASE WHEN max(maxW) = 0 THEN 0 WHEN count(CASE WHEN maxW > 0 THEN 1 END) < 5 THEN max(maxW)
    ELSE exp(avg(CASE WHEN maxW > 0 THEN ln(maxW) END) + stddev_pop(CASE WHEN maxW > 0 THEN ln(maxW) END) * ({qnorm_sql('CAST(0.98 AS DOUBLE)')})) END AS DLL
  FROM recs GROUP BY cuID"""
GROUPED = """SELECT cuID, count(*) AS numST, avg(LATITUDE) AS LATITUDE, avg(LONGITUDE) AS LONGITUDE, avg(ELEVATION) AS ELEVATION,
  first(ECO3 ORDER BY ID) AS ECO3 FROM gst WHERE ID IN (SELECT ID FROM kept) GROUP BY cuID"""


@query("p3_design_loads", with_views("""
SELECT cuID AS CLUSTER, numST, numMax, round(medMax, 6) AS medMax, round(mMax, 6) AS mMax, """ + ", ".join(f"round({c}, 4) AS {c}" for c in LOAD_COLUMNS) + """,
  round(LATITUDE, 6) AS LATITUDE, split_part(ECO3, '.', 1) AS REGIONI FROM loadtab JOIN grp USING (cuID)""",
                                     "obs", "stations", **LOADS, **OUTLIERS, **FINAL, **FULL, grp=GROUPED))
def p3(cat):
    out, _, _ = load_plan.design_loads(cat.obs, grouped_stations(cat), FIRST, LAST, min_seasons=3)
    return out.select(F.col("cuID").alias("CLUSTER"), "numST", "numMax", rnd("medMax").alias("medMax"), rnd("mMax").alias("mMax"),
                      *[rnd(c, 4).alias(c) for c in LOAD_COLUMNS], rnd("LATITUDE").alias("LATITUDE"), "REGIONI")


@query("a13_row_median", with_views("""
SELECT ID, YEAR, round_even(list_median(list_filter([MAX / 3, CAST(MAX_N AS DOUBLE), CAST(YEAR % 31 AS DOUBLE), CASE WHEN MAX > 40 THEN MAX / 7 END], lambda v: v IS NOT NULL)), 3) AS MED
FROM (SELECT ID, YEAR, max(VALUE) AS MAX, count(*) AS MAX_N FROM hy GROUP BY ALL)""".replace("list_median(", "list_aggregate(").replace("v IS NOT NULL))", "v IS NOT NULL), 'median')"),
    "obs_sparse", hy=f"SELECT *, {wy()} AS YEAR FROM obs_sparse WHERE {ROW_RULES}"))
def a13(cat):
    ym = sparse_maxima(cat).withColumns({"a": F.col("MAX") / 3, "b": F.col("MAX_N"), "c": F.col("YEAR") % 31,
                                         "d": F.when(F.col("MAX") > 40, F.col("MAX") / 7)})
    return ym.select("ID", "YEAR", reshape.row_median("a", "b", "c", "d", digits=3).alias("MED"))


@query("p9_final_table", with_views(f"""
SELECT cuID AS CLUSTER, round_even(LATITUDE, 3) AS LATITUDE, CAST(round_even(ELEVATION, 0) AS INTEGER) AS ELEVATION,
  coalesce(CASE region_id WHEN 'A' THEN 10 WHEN 'B' THEN 20 WHEN 'C' THEN 30 WHEN 'D' THEN 40 END, 99999999) AS HUC, numMax,
  round_even(medMax, 3) AS medMax,
  round_even(list_aggregate(list_filter([DLL, DLG, DLI, DLII, DLIII], lambda v: v IS NOT NULL), 'median'), 3) AS load
FROM loadtab JOIN grp USING (cuID) LEFT JOIN regions ON {IN_RECTANGLE}""",
                                    "obs", "stations", "regions", **LOADS, **OUTLIERS, **FINAL, **FULL, grp=GROUPED))
def p9(cat):
    basins = cat.rectangles([(str(10 * (i + 1)), *r[1:]) for i, r in enumerate(RECTANGLES)])
    stations = grouped_stations(cat)
    table, _, _ = load_plan.design_loads(cat.obs, stations, FIRST, LAST, min_seasons=3)
    out = load_plan.final_table([table], basins)
    return out.select(F.col("cuID").alias("CLUSTER"), "LATITUDE", "ELEVATION", "HUC", "numMax", "medMax", "load")


LABELLED = "SELECT ID, G || '.' || lpad(CAST(CLUST AS VARCHAR), 4, '0') AS CLUST FROM clustered"


@query("p1_clustered_fits", recursive(with_views(f"""
SELECT ID AS CLUST, NFIT, round(PAR1, 6) AS PAR1, round(PAR2, 6) AS PAR2,
  round(CASE WHEN Z >= 0.98 THEN 0 WHEN PAR1 IS NULL THEN NULL ELSE {LNORM_LEVEL} END, 4) AS EVENT50
FROM (SELECT *, CASE WHEN N > 1 AND LO > 0 AND HI > LO THEN ML END AS PAR1, CASE WHEN N > 1 AND LO > 0 AND HI > LO THEN SL END AS PAR2 FROM summ)""",
    "obs", "stations", **linkage_ctes("complete", 40, 400, 4, "stations", "ECO3"), lab=LABELLED,
    clean=f"SELECT obs.* REPLACE (lab.CLUST AS ID) FROM obs JOIN lab USING (ID) JOIN stations USING (ID) WHERE left(ECO3, 1) IN ('1', '2', '5') AND {ROW_RULES}",
    ym=YM, summ=SUMMARY)))
def p1(cat):
    out = station.clustered_fits(cat.obs, cat.stations, ["1", "2", "5"], 40, 400, 4)
    return out.select("CLUST", "NFIT", rnd("PAR1").alias("PAR1"), rnd("PAR2").alias("PAR2"), rnd("EVENT50", 4).alias("EVENT50"))


def depth_views(n: int, months: int) -> dict[str, str]:
    """CTE ``covered``: covered yearly maxima of the clusters of ``lab``."""
    return {
        "clean": f"SELECT obs.*, CLUST FROM obs JOIN lab USING (ID) WHERE {ROW_RULES}",
        **high_max_sql("clean", "CLUST"),
        "hm": "SELECT * EXCLUDE (YEAR, HIGH, N_HIGH) FROM survivors",
        "monthly": monthly_sql("hm").replace("ID, ELEMENT", "CLUST, ELEMENT"),
        "tested": f"""SELECT *, sum(CASE WHEN ELEMENT = 'WESD' THEN MAX_N ELSE 0 END) OVER (PARTITION BY CLUST, YEAR) >= {n}
          AND (SELECT count(DISTINCT MONTH) FROM monthly i WHERE i.CLUST = o.CLUST AND i.YEAR = o.YEAR AND i.ELEMENT = 'WESD') >= {months}
          AND max(CASE WHEN ELEMENT = 'WESD' THEN VALUE END) OVER (PARTITION BY CLUST, YEAR) > 0 AS ENOUGH FROM monthly o""",
        "chosen": "SELECT * FROM tested WHERE ELEMENT = 'WESD' OR ENOUGH IS NOT TRUE",
        "yearly": yearly_sql("CLUST, YEAR", "chosen", extra=""", max(CASE WHEN ELEMENT = 'WESD' THEN 1 ELSE 0 END) = 1 AS ANY_WESD,
          first(ELEMENT ORDER BY VALUE DESC, ELEMENT, MONTH) = 'WESD' AS PRIORITIZED"""),
        "covered": f"""SELECT y.*, MEDIAN FROM yearly y JOIN (SELECT CLUST, median(MAX) AS MEDIAN FROM yearly GROUP BY CLUST
          HAVING sum(CASE WHEN MAX <> 0 THEN 1 ELSE 0 END) >= 5) m USING (CLUST) WHERE (MAX_N >= {n} AND MAX_MONTHS >= {months}) OR MAX >= MEDIAN""",
    }


# Clusters at a cut of zero height are the stations.
P2 = {
    "kept0": "SELECT * FROM stations WHERE LATITUDE <= 45 AND STATE <> 'NATION_9'",
    "lab": "SELECT *, ECO3 || '.' || lpad(CAST(row_number() OVER (PARTITION BY ECO3 ORDER BY ID) AS VARCHAR), 4, '0') AS CLUST FROM kept0",
    **depth_views(4, 3),
}


@query("p2_depth_maxima", with_views("""
SELECT CLUST, round(median(MAX), 6) AS MAX, CAST(round_even(median(MAX_MONTH), 0) AS INTEGER) AS MONTH, any_value(LATITUDE) AS LATITUDE,
  any_value(ELEVATION) AS ELEVATION FROM covered JOIN lab USING (CLUST) GROUP BY CLUST""", "obs", "stations", **P2))
def p2(cat):
    states = [f"NATION_{i}" for i in range(25) if i != 9]
    ym, grouped = station.depth_maxima(cat.obs, cat.stations, states, 45, 1, 1, 0, "WESD", 4, 3)
    out = station.depth_table(ym, grouped)
    return out.select("CLUST", rnd("max").alias("MAX"), F.col("month").alias("MONTH"), "LATITUDE", "ELEVATION")


@query("p2_depth_maxima_clustered", recursive(with_views("""
SELECT CLUST, YEAR, MAX, MAX_N, MAX_MONTH, MAX_MONTHS, PRIORITIZED, MONTH_NAMES, MEDIAN FROM covered""", "obs", "stations",
    kept0="SELECT * FROM stations WHERE LATITUDE <= 51", **linkage_ctes("complete", 40, 400, 4, "kept0", "ECO3"), lab=LABELLED, **depth_views(10, 3))))
def p2_clustered(cat):
    states = [f"NATION_{i}" for i in range(25)]
    ym, _ = station.depth_maxima(cat.obs, cat.stations, states, 51, 40, 400, 4, "WESD", 10, 3)
    return ym.select("CLUST", "YEAR", "MAX", "MAX_N", "MAX_MONTH", "MAX_MONTHS", "PRIORITIZED", "MONTH_NAMES", "MEDIAN")
