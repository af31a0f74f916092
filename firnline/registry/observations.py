"""Filters, cleaning rules and maxima over the observation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog import OBS_ORDER, OBS_TIES
from firnline.functions import calendar, labels
from firnline.operators import maxima, qc, rules
from firnline.registry.base import KEY, big, day, query, rnd
from firnline.registry.sqltext import ROW_RULES, with_views, wy
from firnline.sources import scans

K = ", ".join(KEY)


# --- row-wise filters and projections ------------------------------------------

@query("f1_water_year", with_views(f"""
SELECT {K}, {wy()} AS WATER_YEAR,
  year(DATE) + CASE WHEN month(DATE) < 9 THEN 0 ELSE 1 END AS SEASON_YEAR FROM obs""", "obs"))
def f1(cat):
    return cat.obs.select(*KEY, calendar.water_year("DATE").alias("WATER_YEAR"),
                          calendar.season_year("DATE").alias("SEASON_YEAR"))


@query("f2_presumed_zero", with_views(f"""
SELECT {K}, VALUE FROM obs WHERE MFLAG IS NULL OR MFLAG <> 'P'""", "obs"))
def f2(cat):
    return rules.drop_presumed_zero(cat.obs).select(*KEY, "VALUE")


@query("f3_quality_flag", with_views(f"""
SELECT {K}, VALUE FROM obs WHERE QFLAG IS NULL OR trim(QFLAG) = ''""", "obs"))
def f3(cat):
    return rules.keep_unflagged(cat.obs).select(*KEY, "VALUE")


@query("f3_flagged_rows", with_views(f"""
SELECT {K}, QFLAG FROM obs WHERE QFLAG <> ' '""", "obs"))
def f3_inverse(cat):
    return rules.keep_flagged(cat.obs).select(*KEY, "QFLAG")


@query("f4_season_months", with_views(f"""
SELECT {K}, month(DATE) AS MONTH FROM obs WHERE month(DATE) NOT IN (7, 8, 9)""", "obs"))
def f4(cat):
    return rules.drop_months(cat.obs).select(*KEY, F.month("DATE").alias("MONTH"))


@query("f5_year_range", with_views(f"""
SELECT {K}, {wy()} AS YEAR FROM obs WHERE {wy()} BETWEEN 1996 AND 1998""", "obs"))
def f5(cat):
    year = calendar.water_year("DATE")
    return cat.obs.where(year.between(1996, 1998)).select(*KEY, year.alias("YEAR"))


@query("f6_station_filters", with_views("""
SELECT ID, STATE, LATITUDE, ELEVATION FROM stations
WHERE STATE IS NOT NULL AND ELEVATION <> -999.9 AND LATITUDE <> -999.9 AND LONGITUDE <> -999.9
  AND ELEVATION > -100 AND LATITUDE <= 45 AND STATE IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_12', 'NATION_20')""",
                                      "stations"))
def f6(cat):
    known = rules.known_elevation(rules.known_location(cat.stations))
    return rules.in_states(known, ["NATION_1", "NATION_4", "NATION_7", "NATION_12", "NATION_20"], 45).select(
        "ID", "STATE", "LATITUDE", "ELEVATION")


@query("f7_select_rename", with_views("""
SELECT ID, NAME, ELEVATION AS ELEV FROM stations""", "stations"))
def f7(cat):
    return cat.stations.withColumnRenamed("ELEVATION", "ELEV").drop(
        "LATITUDE", "LONGITUDE", "STATE", "ECO3", "STATE_MAX", "COUNTY")


@query("f8_element_year", with_views(f"""
SELECT {K}, ELEMENT FROM obs WHERE year(DATE) <> 1995 OR ELEMENT <> 'WESD'""", "obs"))
def f8(cat):
    return rules.drop_element_year(cat.obs, "WESD", 1995).select(*KEY, "ELEMENT")


@query("f9_fill_flags", with_views(f"""
SELECT {K}, coalesce(MFLAG, ' ') AS MFLAG, coalesce(QFLAG, ' ') AS QFLAG, coalesce(SFLAG, ' ') AS SFLAG
FROM obs""", "obs"))
def f9(cat):
    return rules.fill_flags(cat.obs).select(*KEY, "MFLAG", "QFLAG", "SFLAG")


# --- scoped scans ----------------------------------------------------------------

@query("s2_element_scan", with_views(f"""
SELECT {K}, VALUE FROM obs WHERE ELEMENT = 'WESD'""", "obs"))
def s2(cat):
    return scans.element_scan(cat.obs, ["WESD"]).select(*KEY, "VALUE")


@query("s4_state_scan", with_views(f"""
SELECT {K}, ID, VALUE FROM obs
WHERE ID IN (SELECT ID FROM stations WHERE STATE IN ('NATION_3', 'NATION_17'))""", "obs", "stations"))
def s4(cat):
    return scans.state_scan(cat.obs, cat.stations, ["NATION_3", "NATION_17"]).select(*KEY, "ID", "VALUE")


@query("s5_region_scan", with_views(f"""
SELECT {K}, ID, VALUE FROM obs WHERE ID IN (
  SELECT ID FROM stations WHERE starts_with(ECO3, '2.') OR regexp_matches(ECO3, '^5.1.1') OR starts_with(ECO3, '4.1.'))""",
                                  "obs", "stations"))
def s5(cat):
    return scans.region_scan(cat.obs, cat.stations, ["2", "5.1.1", "4.1"]).select(*KEY, "ID", "VALUE")


@query("s5_region_scan_exact", with_views(f"""
SELECT {K}, ID, VALUE FROM obs WHERE ID IN (
  SELECT ID FROM stations WHERE split_part(ECO3, '.', 1) = '2' OR ECO3 = '5.1.1'
     OR (split_part(ECO3, '.', 1) = '4' AND split_part(ECO3, '.', 2) = '1'))""", "obs", "stations"))
def s5_exact(cat):
    return scans.region_scan(cat.obs, cat.stations, ["2", "5.1.1", "4.1"], exact=True).select(
        *KEY, "ID", "VALUE")


@query("s10_dimension_tables", with_views("""
SELECT 'stations' AS TABLE_NAME, count(*) AS N FROM stations
UNION ALL SELECT 'county_maxes', count(*) FROM county_maxes
UNION ALL SELECT 'obs', count(*) FROM obs""", "stations", "county_maxes", "obs"))
def s10(cat):
    for name in ("stations", "county_maxes", "obs"):
        getattr(cat, name).createOrReplaceTempView(f"firn_{name}")
    return cat.spark.sql("""
        SELECT 'stations' AS TABLE_NAME, count(*) AS N FROM firn_stations
        UNION ALL SELECT 'county_maxes', count(*) FROM firn_county_maxes
        UNION ALL SELECT 'obs', count(*) FROM firn_obs""")


# --- cleaning ---------------------------------------------------------------------

CLEAN = f"SELECT * FROM obs WHERE {ROW_RULES}"
OVER_STATE = """STATE_MAX IS NOT NULL AND ((ELEMENT = 'SNWD' AND VALUE > STATE_MAX)
  OR (ELEMENT = 'WESD' AND VALUE > 5 * STATE_MAX))"""


def county_flags_sql(source: str, multiplier: float = 1) -> dict[str, str]:
    """Stepwise CTEs: gap and rise, limit, own flag, filled flag."""
    part = "PARTITION BY ID, ELEMENT, YEAR ORDER BY DATE, k_order, k_line, k_part, k_supp"
    return {
        "dated": f"SELECT *, {wy()} AS YEAR FROM {source}",
        "steps": f"""SELECT *, coalesce(DATE - lag(DATE) OVER (w), 1) AS DAYS,
            coalesce(VALUE - lag(VALUE) OVER (w), VALUE) AS VDIFF,
            lag(VALUE) OVER (w) AS PREV FROM dated WINDOW w AS ({part})""",
        "limited": """SELECT s.*, c.COUNTY_MAX FROM steps s
            LEFT JOIN stations t ON s.ID = t.ID
            LEFT JOIN county_maxes c ON t.STATE = c.STATE AND t.COUNTY = c.COUNTY AND s.DAYS = c.DAYS""",
        "marked": f"""SELECT *, CASE WHEN PREV IS NOT NULL AND VALUE = PREV THEN NULL
            ELSE COUNTY_MAX IS NOT NULL AND ((ELEMENT = 'SNWD' AND VDIFF > COUNTY_MAX * {multiplier})
              OR (ELEMENT = 'WESD' AND VDIFF > COUNTY_MAX * 5 * {multiplier})) END AS FLAG FROM limited""",
        "filled": f"""SELECT *, coalesce(last_value(FLAG IGNORE NULLS) OVER ({part}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS IS_OUT FROM marked""",
    }


@query("q1_q3_row_rules", with_views(f"SELECT {K}, VALUE FROM obs WHERE {ROW_RULES}", "obs"))
def q1_q3(cat):
    return qc.clean_station_data(cat.obs).select(*KEY, "VALUE")


@query("q4_state_max", with_views(f"""
SELECT {K}, VALUE FROM obs LEFT JOIN stations USING (ID) WHERE NOT ({OVER_STATE})""", "obs", "stations"))
def q4(cat):
    return qc.clean_station_data(cat.obs, ["state_max"], stations=cat.stations).select(*KEY, "VALUE")


@query("q5_county_max", with_views(f"SELECT {K}, VALUE FROM filled WHERE NOT IS_OUT",
                                  "obs", "stations", "county_maxes", **county_flags_sql("obs")))
def q5(cat):
    return qc.clean_station_data(cat.obs, ["county_max"], stations=cat.stations,
                                 county_maxes=cat.county_maxes, order=OBS_ORDER).select(*KEY, "VALUE")


@query("q5_county_max_scaled", with_views(
    f"SELECT {K}, VALUE FROM filled WHERE NOT IS_OUT", "obs", "stations", "county_maxes",
    clean=CLEAN, **county_flags_sql("clean", 0.5)))
def q5_scaled(cat):
    return qc.clean_station_data(cat.obs, ["mpzero", "qflag", "month", "county_max"], stations=cat.stations,
                                 county_maxes=cat.county_maxes, county_multiplier=0.5,
                                 order=OBS_ORDER).select(*KEY, "VALUE")


def high_max_sql(source: str, group: str, cutoff=3, few=5) -> dict[str, str]:
    return {
        "hy": f"SELECT *, {wy()} AS YEAR FROM {source}",
        "ymax": f"SELECT {group} AS G, YEAR, ln(max(VALUE) + 1) AS M FROM hy GROUP BY ALL",
        "quart": "SELECT G, quantile_cont(M, 0.75) AS Q75, quantile_cont(M, 0.25) AS Q25, max(M) AS TOP FROM ymax GROUP BY G",
        "cuts": f"""SELECT G, Q75, Q25, CASE WHEN exp(Q75) - exp(Q25) < 1 THEN TOP
                    ELSE Q75 + {cutoff} * (Q75 - Q25) END AS CUTOFF FROM quart""",
        "above": f"""SELECT hy.*, ln(VALUE + 1) > CUTOFF AS HIGH FROM hy
                    JOIN cuts ON hy.{group} IS NOT DISTINCT FROM cuts.G""",
        "counted": f"""SELECT *, sum(CASE WHEN HIGH THEN 1 ELSE 0 END) OVER (PARTITION BY {group}, YEAR) AS N_HIGH
                    FROM above""",
        "survivors": f"SELECT * FROM counted WHERE NOT (HIGH AND N_HIGH < {few})",
    }


@query("q6_high_max", with_views(f"SELECT {K}, VALUE FROM survivors", "obs_sparse",
                                 **high_max_sql("obs_sparse", "ID")))
def q6(cat):
    return qc.clean_station_data(cat.obs_sparse, ["high_max"]).select(*KEY, "VALUE")


@query("q6_high_max_by_state", with_views(
    f"SELECT {K}, VALUE FROM survivors", "obs", "stations",
    joined="SELECT obs.*, STATE FROM obs LEFT JOIN stations USING (ID)", **high_max_sql("joined", "STATE", 1)))
def q6_state(cat):
    joined = cat.obs.join(cat.stations.select("ID", "STATE"), "ID", "left")
    return qc.clean_station_data(joined, ["high_max"], max_grouping="STATE", iqr_cutoff=1).select(*KEY, "VALUE")


@query("a7_iqr_cutoff", with_views("""
SELECT G AS ID, round(Q75, 6) AS Q75, round(Q25, 6) AS Q25, round(CUTOFF, 6) AS CUTOFF FROM cuts""",
                                   "obs_sparse", **{k: v for k, v in high_max_sql("obs_sparse", "ID").items()
                                                    if k in ("hy", "ymax", "quart", "cuts")}))
def a7(cat):
    return qc.high_max_cutoffs(cat.obs_sparse).select("ID", rnd("Q75").alias("Q75"), rnd("Q25").alias("Q25"),
                                                      rnd("CUTOFF").alias("CUTOFF"))


def corrupt_sql(condition: str) -> dict[str, str]:
    return {
        "clean": CLEAN,
        "flagged": f"SELECT clean.*, {wy()} AS YEAR, {OVER_STATE} AS OUT FROM clean LEFT JOIN stations USING (ID)",
        "counted": """SELECT *, count(*) OVER (PARTITION BY ID, YEAR) AS N,
            sum(CASE WHEN OUT THEN 0 ELSE 1 END) OVER (PARTITION BY ID, YEAR) AS POST FROM flagged""",
        "kept": f"SELECT * FROM counted WHERE NOT OUT AND NOT ({condition})",
    }


@query("q7_corrupt_years_share", with_views(f"SELECT {K}, VALUE FROM kept", "obs", "stations",
                                            **corrupt_sql("POST / N <= 1 - 0.1")))
def q7_share(cat):
    return qc.clean_station_data(cat.obs, ["all", "state_max", "corrupt_years"], yearly_threshold=0.1,
                                 stations=cat.stations).select(*KEY, "VALUE")


@query("q7_corrupt_years_count", with_views(f"SELECT {K}, VALUE FROM kept", "obs", "stations",
                                            **corrupt_sql("N - POST >= 4")))
def q7_count(cat):
    return qc.clean_station_data(cat.obs, ["all", "state_max", "corrupt_years"], yearly_threshold=4,
                                 stations=cat.stations).select(*KEY, "VALUE")


@query("a15_year_counts", with_views("""
SELECT ID, YEAR, N, CAST(sum(CASE WHEN OUT THEN 0 ELSE 1 END) AS BIGINT) AS POST FROM counted GROUP BY ID, YEAR, N""",
                                     "obs", "stations", **corrupt_sql("false")))
def a15(cat):
    rows = qc.clean_station_data(cat.obs)
    marked = qc.above_state_max(rows, cat.stations)
    return marked.groupBy("ID", calendar.water_year("DATE").alias("YEAR")).agg(
        F.count(F.lit(1)).alias("N"), big(F.sum(F.when(F.col("_above"), 0).otherwise(1))).alias("POST"))


@query("q8_removal_report", with_views(f"""
SELECT CASE WHEN MFLAG = 'P' THEN 'mpzero' WHEN trim(coalesce(QFLAG, '')) <> '' THEN 'qflag'
  WHEN month(DATE) IN (7, 8, 9) THEN 'month' WHEN {OVER_STATE} THEN 'state_max' ELSE 'kept' END AS RULE,
  count(*) AS N FROM obs LEFT JOIN stations USING (ID) GROUP BY 1""", "obs", "stations"))
def q8(cat):
    return qc.removal_report(cat.obs, stations=cat.stations)


LOSS = {"c0": CLEAN, "c1": f"SELECT c0.* FROM c0 LEFT JOIN stations USING (ID) WHERE NOT coalesce({OVER_STATE}, false)",
        **county_flags_sql("c1"), "c2": "SELECT * FROM filled WHERE NOT IS_OUT",
        "bad": f"""SELECT a.ID, a.Y FROM (SELECT ID, {wy()} AS Y, count(*) AS n FROM c0 GROUP BY ALL) a
          LEFT JOIN (SELECT ID, YEAR AS Y, count(*) AS k FROM c2 GROUP BY ALL) b ON a.ID = b.ID AND a.Y = b.Y
          WHERE coalesce(k, 0) / n <= 1 - 0.1""",
        "c3": "SELECT c2.* FROM c2 ANTI JOIN bad ON c2.ID = bad.ID AND c2.YEAR = bad.Y"}


@query("q8_rule_losses", with_views("""
SELECT 'mpzero' AS RULE, (SELECT count(*) FROM obs WHERE MFLAG = 'P') AS N
UNION ALL SELECT 'qflag', (SELECT count(*) FROM obs WHERE MFLAG IS DISTINCT FROM 'P' AND trim(coalesce(QFLAG, '')) <> '')
UNION ALL SELECT 'month', (SELECT count(*) FROM obs WHERE MFLAG IS DISTINCT FROM 'P' AND trim(coalesce(QFLAG, '')) = '') - (SELECT count(*) FROM c0)
UNION ALL SELECT 'state_max', (SELECT count(*) FROM c0) - (SELECT count(*) FROM c1)
UNION ALL SELECT 'county_max', (SELECT count(*) FROM c1) - (SELECT count(*) FROM c2)
UNION ALL SELECT 'corrupt_years', (SELECT count(*) FROM c2) - (SELECT count(*) FROM c3)
UNION ALL SELECT 'kept', (SELECT count(*) FROM c3)
UNION ALL SELECT 'high_max', (SELECT count(*) FROM obs_sparse) - (SELECT count(*) FROM survivors)""",
                                    "obs", "obs_sparse", "stations", "county_maxes", **LOSS, **high_max_sql("obs_sparse", "ID")))
def q8_all(cat):
    limits = {"stations": cat.stations, "county_maxes": cat.county_maxes, "order": OBS_ORDER}
    one = qc.rule_losses(cat.obs, ["all", "state_max", "county_max", "corrupt_years"], yearly_threshold=0.1, **limits)
    other = qc.rule_losses(cat.obs_sparse, ["high_max"]).where(F.col("RULE") == "high_max")
    return one.union(other)


@query("w1_daily_steps", with_views(f"SELECT {K}, YEAR, DAYS, VDIFF FROM steps", "obs",
                                    **{k: v for k, v in county_flags_sql("obs").items() if k in ("dated", "steps")}))
def w1(cat):
    return qc.daily_steps(cat.obs, OBS_ORDER).select(*KEY, "YEAR", big("DAYS").alias("DAYS"), "VDIFF")


@query("w2_fill_down", with_views(f"SELECT {K}, IS_OUT FROM filled", "obs", "stations", "county_maxes",
                                  **county_flags_sql("obs")))
def w2(cat):
    return qc.above_county_max(cat.obs, cat.stations, cat.county_maxes, order=OBS_ORDER, out="IS_OUT").select(
        *KEY, "IS_OUT")


# --- maxima -----------------------------------------------------------------------

def monthly_sql(source: str, by_type: bool = True) -> str:
    part = "ID, ELEMENT" if by_type else "ID"
    return f"""SELECT * FROM (SELECT *, {wy()} AS YEAR, month(DATE) AS MONTH,
      count(*) OVER (PARTITION BY {part}, {wy()}, month(DATE)) AS MAX_N,
      row_number() OVER (PARTITION BY {part}, {wy()}, month(DATE)
        ORDER BY VALUE DESC NULLS LAST, DATE, k_order, k_line, k_part, k_supp) AS RN FROM {source}) WHERE RN = 1"""


def yearly_sql(keys: str = "ID, YEAR", kept: str = "monthly", every: str = "monthly",
               typed: bool = True, extra: str = "") -> str:
    """Yearly summary in window form, independent of the aggregate form it checks."""
    order = "VALUE DESC, ELEMENT, MONTH" if typed else "VALUE DESC, MONTH"
    names = "ELEMENT, MONTH" if typed else "MONTH"
    return f"""SELECT {keys}, max(VALUE) AS MAX, CAST(sum(MAX_N) AS BIGINT) AS MAX_N,
      first(MONTH ORDER BY {order}) AS MAX_MONTH, count(DISTINCT MONTH) AS MAX_MONTHS{extra},
      any_value(MONTH_NAMES) AS MONTH_NAMES
      FROM {kept} JOIN (SELECT {keys}, string_agg(m, ':' ORDER BY pos) AS MONTH_NAMES FROM (
        SELECT {keys}, CAST(MONTH AS VARCHAR) AS m, min(pos) AS pos FROM (
          SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {names}) AS pos FROM {every}) GROUP BY ALL)
        GROUP BY {keys}) USING ({keys}) GROUP BY {keys}"""


PRIORITY = {
    "monthly": monthly_sql("clean"),
    "tested": """SELECT *, sum(CASE WHEN ELEMENT = 'WESD' THEN MAX_N ELSE 0 END) OVER (PARTITION BY ID, YEAR) >= 4
      AND (SELECT count(DISTINCT MONTH) FROM monthly i WHERE i.ID = o.ID AND i.YEAR = o.YEAR AND i.ELEMENT = 'WESD') >= 3
      AND max(CASE WHEN ELEMENT = 'WESD' THEN VALUE END) OVER (PARTITION BY ID, YEAR) > 0 AS ENOUGH FROM monthly o""",
    "chosen": "SELECT * FROM tested WHERE ELEMENT = 'WESD' OR ENOUGH IS NOT TRUE",
}


@query("y1_monthly_maximums", with_views(f"""
SELECT ID, ELEMENT, YEAR, MONTH, VALUE, strftime(DATE, '%Y-%m-%d') AS DAY, k_order, k_line, MAX_N FROM monthly""",
                                         "obs", monthly=monthly_sql("obs")))
def y1(cat):
    return maxima.monthly_maximums(cat.obs, "ID", "DATE", "VALUE", "ELEMENT", OBS_TIES).select(
        "ID", "ELEMENT", "YEAR", "MONTH", "VALUE", day().alias("DAY"), "k_order", "k_line", "MAX_N")


YM_COLUMNS = ["MAX", "MAX_N", "MAX_MONTH", "MAX_MONTHS", "MONTH_NAMES"]


@query("y2_yearly_maximums", with_views(yearly_sql(typed=False), "obs", clean=CLEAN,
                                        monthly=monthly_sql("clean", False)))
def y2(cat):
    return maxima.yearly_maximums(qc.clean_station_data(cat.obs), "ID", "DATE", "VALUE")


@query("y2a_yearly_by_type", with_views(yearly_sql("ID, ELEMENT, YEAR"), "obs", clean=CLEAN,
                                        monthly=monthly_sql("clean")))
def y2a(cat):
    return maxima.yearly_maximums(qc.clean_station_data(cat.obs), "ID", "DATE", "VALUE", value_type="ELEMENT")


PRIORITIZED_SQL = ", first(ELEMENT ORDER BY VALUE DESC, ELEMENT, MONTH) = 'WESD' AS PRIORITIZED"


@query("y2b_yearly_prioritized", with_views(
    yearly_sql(kept="chosen", extra=PRIORITIZED_SQL), "obs_sparse",
    **{"clean": f"SELECT * FROM obs_sparse WHERE {ROW_RULES}", **PRIORITY}))
def y2b(cat):
    return maxima.yearly_maximums(qc.clean_station_data(cat.obs_sparse), "ID", "DATE", "VALUE",
                                  value_type="ELEMENT", prioritize="WESD", n=4, months=3)


@query("y2c_from_monthly", with_views(
    yearly_sql(kept="chosen", extra=PRIORITIZED_SQL), "obs", **{"clean": CLEAN, **PRIORITY}))
def y2c(cat):
    mm = maxima.monthly_maximums(qc.clean_station_data(cat.obs), "ID", "DATE", "VALUE", "ELEMENT", OBS_TIES)
    return maxima.yearly_maximums(mm, "ID", None, "VALUE", value_type="ELEMENT", prioritize=["WESD"],
                                  n=4, months=3, monthly=True)


@query("y2d_ratio", with_views("""
SELECT ID, YEAR, max(VALUE) AS MAX, first(RATIO ORDER BY VALUE DESC, MONTH) AS RATIO FROM monthly GROUP BY ID, YEAR""",
                               "obs", rated="SELECT *, (k_order % 97) / CAST(97 AS DOUBLE) AS RATIO FROM obs",
                               monthly=monthly_sql("rated", False)))
def y2d(cat):
    rated = cat.obs.withColumn("RATIO", (F.col("k_order") % 97) / F.lit(97.0))
    return maxima.yearly_maximums(rated, "ID", "DATE", "VALUE", ratio="RATIO", ties=OBS_TIES).select(
        "ID", "YEAR", "MAX", "RATIO")


@query("y3_coverage", with_views("""
SELECT y.ID, y.YEAR, y.MAX, y.MAX_N, m.MEDIAN FROM yearly y JOIN
  (SELECT ID, median(MAX) AS MEDIAN FROM yearly GROUP BY ID HAVING sum(CASE WHEN MAX <> 0 THEN 1 ELSE 0 END) >= 5) m
  ON y.ID = m.ID WHERE (MAX_N >= 4 AND MAX_MONTHS >= 3) OR MAX >= MEDIAN""", "obs_sparse",
    clean=f"SELECT * FROM obs_sparse WHERE {ROW_RULES}",
    monthly=monthly_sql("clean"), yearly=yearly_sql()))
def y3(cat):
    ym = maxima.yearly_maximums(qc.clean_station_data(cat.obs_sparse), "ID", "DATE", "VALUE",
                                value_type="ELEMENT", prioritize="NONE")
    return maxima.coverage_filter(ym, "ID", 5, 4, 3).select("ID", "YEAR", "MAX", "MAX_N", "MEDIAN")
