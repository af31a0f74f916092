"""Formats, joins, aggregates, set operations, reshaping and review lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from firnline.catalog import OBS_ORDER
from firnline.functions import calendar, labels, loads as conv
from firnline.operators import maxima, qc, reshape, reviews, rules
from firnline.operators.quantiles import exact_quantiles
from firnline.plans import reviews as review_plan
from firnline.registry.base import KEY, big, day, query, rnd
from firnline.registry.sqltext import ROW_RULES, with_views, wy
from firnline.session import scratch_path
from firnline.sources import daily, scans, tables

K = ", ".join(KEY)

# --- formats ---------------------------------------------------------------------------

DAILY = """SELECT printf('ST%09d', ID) AS ID, DATE, ELEMENT, max(VALUE) AS VALUE, max(coalesce(MFLAG, '')) AS MFLAG,
  max(coalesce(QFLAG, '')) AS QFLAG, max(SFLAG) AS SFLAG FROM obs GROUP BY ALL"""


def daily_values(cat):
    """One observation per station, day and element, as the formats need."""
    rows = cat.obs.groupBy("ID", "DATE", "ELEMENT").agg(
        F.max("VALUE").alias("VALUE"), F.max(F.coalesce("MFLAG", F.lit(""))).alias("MFLAG"),
        F.max(F.coalesce("QFLAG", F.lit(""))).alias("QFLAG"), F.max("SFLAG").alias("SFLAG"))
    return rows.withColumn("ID", F.format_string("ST%09d", "ID"))


def _flags(df):
    return [F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("MFLAG", "QFLAG", "SFLAG")]


DAILY_OUT = """SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, trim(MFLAG) AS MFLAG, trim(QFLAG) AS QFLAG,
  trim(SFLAG) AS SFLAG FROM daily"""


@query("s1_fixed_width_lines", with_views(DAILY_OUT, "obs", daily=DAILY))
def s1(cat):
    lines = daily.format_daily_lines(daily_values(cat))
    back = daily.parse_daily_lines(lines)
    return back.select("ID", day().alias("DAY"), "ELEMENT", "VALUE", *_flags(back))


@query("s3_missing_stations", with_views("""
SELECT ID FROM (SELECT ID FROM places) WHERE ID NOT IN (SELECT ID FROM obs)""", "places", "obs"))
def s3(cat):
    return scans.missing_stations(cat.places, cat.obs)


def station_folder(cat):
    """A folder with a file for each station."""
    folder = scratch_path(cat.spark, "stations")
    daily.write_station_files(daily_values(cat), folder)
    return folder


def written_files(cat):
    return daily.station_files(cat.spark, station_folder(cat), daily.WRITTEN_GLOB, daily.WRITTEN_NAME)


def named_stations(cat):
    return cat.stations.withColumn("ID", F.format_string("ST%09d", "ID"))


def _by_station(rows):
    """Rows and total of each station, and how many files the whole scan opened."""
    found = rows.groupBy("ID").agg(big(F.count(F.lit(1))).alias("N"), rnd(F.sum("VALUE")).alias("TOTAL"), F.min("path").alias("_path"))
    opened = found.agg(big(F.countDistinct("_path")).alias("FILES"))
    return found.drop("_path").join(opened)


PICKED = """SELECT ID, CAST(count(*) AS BIGINT) AS N, round(sum(VALUE), 6) AS TOTAL, CAST((SELECT count(DISTINCT ID) FROM picked) AS BIGINT) AS FILES
FROM picked GROUP BY ID"""


@query("s4_state_files", with_views(PICKED, "obs", "stations", daily=DAILY, picked="""SELECT daily.* FROM daily
  JOIN stations s ON daily.ID = printf('ST%09d', s.ID) WHERE s.STATE IN ('NATION_3', 'NATION_17')"""))
def s4_files(cat):
    files = written_files(cat).join(daily.in_states(named_stations(cat), ["NATION_3", "NATION_17"]).select("ID"), "ID", "left_semi")
    return _by_station(daily.files_data(files, path=True))


@query("s5_region_files", with_views(PICKED, "obs", "stations", daily=DAILY, picked="""SELECT daily.* FROM daily
  JOIN stations s ON daily.ID = printf('ST%09d', s.ID) WHERE starts_with(ECO3, '2.') OR regexp_matches(ECO3, '^5.1.1') OR starts_with(ECO3, '4.1.')"""))
def s5_files(cat):
    files = written_files(cat).join(daily.in_regions(named_stations(cat), ["2", "5.1.1", "4.1"]).select("ID"), "ID", "left_semi")
    return _by_station(daily.files_data(files, path=True))


@query("s3_missing_files", with_views("""
SELECT printf('ST%09d', ID) AS ID FROM places WHERE printf('ST%09d', ID) NOT IN (SELECT ID FROM daily)""", "places", "obs", daily=DAILY))
def s3_files(cat):
    asked = cat.places.select(F.format_string("ST%09d", "ID").alias("ID"))
    return daily.missing_files(cat.spark, station_folder(cat), asked, daily.WRITTEN_GLOB, daily.WRITTEN_NAME)


@query("c17_file_tags", with_views("""
SELECT CASE WHEN ID LIKE '%7' THEN 'first' WHEN ID LIKE '%3_' THEN 'second' ELSE 'unknown' END AS name, ELEMENT, CAST(count(*) AS BIGINT) AS N,
  CAST(count(DISTINCT ID) AS BIGINT) AS FILES FROM daily GROUP BY ALL""", "obs", daily=DAILY))
def c17_files(cat):
    tag = labels.reviewer_tag("path", {"first": r"ID=ST\d*7/", "second": r"ID=ST\d*3\d/"})
    return (daily.files_data(written_files(cat), path=True).withColumn("name", tag).groupBy("name", "ELEMENT")
            .agg(big(F.count(F.lit(1))).alias("N"), big(F.countDistinct("path")).alias("FILES")))


@query("s6_yearly_csv", with_views(DAILY_OUT + " WHERE ELEMENT = 'WESD' AND year(DATE) IN (1996, 1999)", "obs", daily=DAILY))
def s6(cat):
    root = scratch_path(cat.spark, "by-year")
    tables.write_year_data(daily_values(cat), root)
    back = tables.get_year_data(cat.spark, root, [1996, 1999, 1850], ["WESD"])
    return back.select("ID", day().alias("DAY"), "ELEMENT", "VALUE", *_flags(back))


@query("s7_no_match", with_views("SELECT count(*) AS N FROM obs WHERE ID IN (SELECT ID FROM stations WHERE STATE = 'NOWHERE')", "obs", "stations"))
def s7(cat):
    return scans.state_scan(cat.obs, cat.stations, ["NOWHERE"]).agg(big(F.count(F.lit(1))).alias("N"))


@query("s9_review_lists", with_views("""
SELECT ID::VARCHAR AS ID, strftime(DATE, '%Y-%m-%d') AS DATE, round(VALUE, 2)::VARCHAR AS VALUE, CASE WHEN l = 'a' THEN 'x' END AS FLAGGED,
  CASE WHEN l = 'b' THEN ELEMENT END AS REMARK, l AS LIST FROM (SELECT *, 'a' AS l FROM obs WHERE VALUE > 45 UNION ALL SELECT *, 'b' FROM obs WHERE VALUE < 2)""", "obs"))
def s9(cat):
    """Hand-made lists with differing columns, written as CSV and read as one."""
    root = scratch_path(cat.spark, "lists")
    value = F.round("VALUE", 2).cast("string").alias("VALUE")
    tables.write_csv(cat.obs.where("VALUE > 45").select("ID", day().alias("DATE"), value, F.lit("x").alias("FLAGGED")), f"{root}/a")
    tables.write_csv(cat.obs.where("VALUE < 2").select("ID", day().alias("DATE"), value, F.col("ELEMENT").alias("REMARK")), f"{root}/b")
    both = tables.read_review_lists(cat.spark, [f"{root}/a", f"{root}/b"])
    return both.select("ID", "DATE", "VALUE", "FLAGGED", "REMARK", F.regexp_extract("_path", "([ab])$", 1).alias("LIST"))


@query("s11_auxiliary_csv", """
SELECT n_name AS STATE, (n_nationkey % 7 + 1)::DOUBLE AS RECORD FROM nation""")
def s11(cat):
    path = scratch_path(cat.spark, "records")
    tables.write_csv(cat.table("nation").select(F.col("n_name").alias("STATE"), (F.col("n_nationkey") % 7 + 1).alias("RECORD")), path)
    return tables.read_csv(cat.spark, path, "STATE string, RECORD double")


@query("s14_polygon_layer", with_views("""
SELECT region_id, count(*) AS N, round(sum(x1 + 2 * y1 + 3 * x2 + 4 * y2), 6) AS TOTAL FROM edges GROUP BY region_id""", "regions", "edges"))
def s14(cat):
    from firnline.registry.spatial import regions
    path = scratch_path(cat.spark, "edges")
    tables.save_table(regions(cat), path)
    back = tables.read_polygon_edges(cat.spark, path)
    return back.groupBy("region_id").agg(F.count(F.lit(1)).alias("N"), rnd(F.sum(F.expr("x1 + 2 * y1 + 3 * x2 + 4 * y2"))).alias("TOTAL"))


@query("s15_grid_layer", with_views("SELECT row::BIGINT AS ROW, col::BIGINT AS COL, round(x, 6) AS X, round(y, 6) AS Y, PPTWT, TD, MAT FROM grid", "grid"))
def s15(cat):
    path = scratch_path(cat.spark, "grid")
    tables.save_table(cat.grid, path)
    return tables.read_grid(cat.spark, path).select(big("row").alias("ROW"), big("col").alias("COL"), rnd("x").alias("X"), rnd("y").alias("Y"), "PPTWT", "TD", "MAT")


@query("s8_station_inventory", with_views("""
SELECT printf('ST%09d', ID) AS ID, LATITUDE, LONGITUDE, ELEVATION, left(STATE, 2) AS STATE, NAME FROM stations""", "stations"))
def s8(cat):
    s = cat.stations

    def put(c, width):
        return F.rpad(c, width, " ")

    line = F.concat(
        put(F.format_string("ST%09d", "ID"), 11), F.lpad(F.format_string("%.4f", "LATITUDE"), 9, " "),
        F.lpad(F.format_string("%.4f", "LONGITUDE"), 10, " "), F.lpad(F.format_string("%.1f", "ELEVATION"), 7, " "),
        F.concat(F.lit(" "), put(F.col("STATE"), 2)), F.concat(F.lit(" "), put(F.col("NAME"), 30)), F.lit(" " * 14))
    return tables.parse_inventory(s.select(line.alias("value"))).select(
        "ID", "LATITUDE", "LONGITUDE", "ELEVATION", "STATE", "NAME")


@query("s12_csv_sink", with_views(f"""
SELECT ID, {wy()} AS YEAR, max(VALUE) AS MAX FROM obs GROUP BY ALL""", "obs"))
def s12(cat):
    path = scratch_path(cat.spark, "csv")
    tables.write_csv(maxima.yearly_maximums(cat.obs, "ID", "DATE", "VALUE").select("ID", "YEAR", "MAX"), path)
    return tables.read_csv(cat.spark, path, "ID long, YEAR int, MAX double")


@query("s13_partitioned_table", with_views(f"SELECT {K}, VALUE FROM obs WHERE ELEMENT = 'SNWD' AND year(DATE) = 1998", "obs"))
def s13(cat):
    path = scratch_path(cat.spark, "observations")
    tables.save_observations(cat.obs, path)
    return tables.read_table(cat.spark, path).where(
        (F.col("ELEMENT") == "SNWD") & (F.col("YEAR") == 1998)).select(*KEY, "VALUE")


# --- joins -----------------------------------------------------------------------------

@query("j1_station_join", with_views(f"SELECT {K}, STATE, ECO3, ELEVATION FROM obs LEFT JOIN stations USING (ID)", "obs", "stations"))
def j1(cat):
    return cat.obs.join(cat.stations, "ID", "left").select(*KEY, "STATE", "ECO3", "ELEVATION")


@query("j2_county_limit_join", with_views(f"""
SELECT {K}, coalesce(COUNTY_MAX, -1) AS COUNTY_MAX FROM (SELECT *, day(DATE) AS DAYS FROM obs) o
LEFT JOIN stations USING (ID) LEFT JOIN county_maxes USING (STATE, COUNTY, DAYS)""", "obs", "stations", "county_maxes"))
def j2(cat):
    limits = qc.station_limits(cat.stations, cat.county_maxes)
    limit = F.try_element_at("_limits", F.dayofmonth("DATE"))
    return cat.obs.join(limits, "ID", "left").select(*KEY, F.coalesce(limit, F.lit(-1.0)).alias("COUNTY_MAX"))


PLAIN = "SELECT ID, DATE, ELEMENT, VALUE, MFLAG, QFLAG, SFLAG FROM obs"


@query("j3_natural_anti_join", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, count(*) AS N FROM plain
WHERE NOT (VALUE > 40 AND MFLAG IS NULL) GROUP BY ALL""", "obs", plain=PLAIN))
def j3(cat):
    plain = cat.obs.drop(*KEY)
    outliers = plain.where((F.col("VALUE") > 40) & F.col("MFLAG").isNull())
    return rules.anti(plain, outliers).groupBy("ID", day().alias("DAY"), "ELEMENT", "VALUE").agg(F.count(F.lit(1)).alias("N"))


@query("j4_keyed_anti_join", with_views(f"""
SELECT {K}, VALUE FROM obs o WHERE NOT EXISTS (SELECT 1 FROM obs f WHERE f.QFLAG = 'G' AND f.ID = o.ID AND f.DATE = o.DATE
  AND f.ELEMENT = o.ELEMENT)""", "obs"))
def j4(cat):
    flagged = cat.obs.where(F.col("QFLAG") == "G")
    return rules.anti(cat.obs, flagged, ["ID", "DATE", "ELEMENT"]).select(*KEY, "VALUE")


@query("j8_membership_flag", with_views("""
SELECT s.ID, s.ID IN (SELECT ID FROM obs WHERE VALUE > 4000) AS EXTREME FROM stations s""", "stations", "obs"))
def j8(cat):
    high = cat.obs.where(F.col("VALUE") > 4000).select(F.col("ID").alias("_id")).distinct()
    return cat.stations.join(high, F.col("ID") == F.col("_id"), "left").select("ID", F.col("_id").isNotNull().alias("EXTREME"))


@query("j22_group_stats_join", with_views(f"""
SELECT {K}, round(VALUE - m, 6) AS ANOMALY FROM obs JOIN (SELECT ID, ELEMENT, avg(VALUE) AS m FROM obs GROUP BY ALL) USING (ID, ELEMENT)""", "obs"))
def j22(cat):
    means = cat.obs.groupBy("ID", "ELEMENT").agg(F.avg("VALUE").alias("m"))
    return cat.obs.join(means, ["ID", "ELEMENT"]).select(*KEY, rnd(F.col("VALUE") - F.col("m")).alias("ANOMALY"))


# --- aggregates, windows, sorts -----------------------------------------------------------

@query("a1_group_summary", with_views("""
SELECT ID, ELEMENT, max(VALUE) AS MAX, sum(VALUE) AS TOTAL, count(*) AS N, count(DISTINCT DATE) AS DAYS FROM obs GROUP BY ALL""", "obs"))
def a1(cat):
    return cat.obs.groupBy("ID", "ELEMENT").agg(F.max("VALUE").alias("MAX"), F.sum("VALUE").alias("TOTAL"),
                                                F.count(F.lit(1)).alias("N"), F.count_distinct("DATE").alias("DAYS"))


@query("a2_argmax_month", with_views("""
SELECT ID, CAST(first(month(DATE) ORDER BY VALUE DESC, month(DATE)) AS INTEGER) AS MAX_MONTH FROM obs GROUP BY ID""", "obs"))
def a2(cat):
    return cat.obs.groupBy("ID").agg(F.min_by(F.month("DATE"), F.struct(-F.col("VALUE"), F.month("DATE"))).alias("MAX_MONTH"))


@query("a3_month_names", with_views(f"""
SELECT ID, YEAR, string_agg(CAST(m AS VARCHAR), ':' ORDER BY m) AS MONTH_NAMES FROM (
  SELECT DISTINCT ID, {wy()} AS YEAR, month(DATE) AS m FROM obs_sparse) GROUP BY ALL""", "obs_sparse"))
def a3(cat):
    return maxima.yearly_maximums(cat.obs_sparse, "ID", "DATE", "VALUE").select("ID", "YEAR", "MONTH_NAMES")


@query("a6_quantiles", with_views("""
SELECT ID, round(quantile_cont(VALUE, 0.1), 6) AS Q10, round(quantile_cont(VALUE, 0.25), 6) AS Q25,
  round(median(VALUE), 6) AS Q50, round(quantile_cont(VALUE, 0.75), 6) AS Q75 FROM obs GROUP BY ID""", "obs"))
def a6(cat):
    found = exact_quantiles(cat.obs, ["ID"], "VALUE", {"Q10": 0.1, "Q25": 0.25, "Q50": 0.5, "Q75": 0.75})
    return found.select("ID", *[rnd(n).alias(n) for n in ("Q10", "Q25", "Q50", "Q75")])


@query("a6_quantiles_of_all", """SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS Q01, round(median(l_extendedprice), 6) AS Q50,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS Q99 FROM lineitem""")
def a6_all(cat):
    """One group of all rows."""
    found = exact_quantiles(cat.table("lineitem"), [], "l_extendedprice", {"Q01": 0.01, "Q50": 0.5, "Q99": 0.99})
    return found.select(*[rnd(n).alias(n) for n in found.columns])


@query("a8_group_centroid", with_views("""
SELECT STATE, first(NAME ORDER BY ID) AS NAME, round(avg(LATITUDE), 6) AS LATITUDE, round(avg(LONGITUDE), 6) AS LONGITUDE,
  round(avg(ELEVATION), 6) AS ELEVATION, count(*) AS N FROM stations GROUP BY STATE""", "stations"))
def a8(cat):
    return cat.stations.groupBy("STATE").agg(
        F.min_by("NAME", "ID").alias("NAME"), *[rnd(F.avg(c)).alias(c) for c in ("LATITUDE", "LONGITUDE", "ELEVATION")],
        F.count(F.lit(1)).alias("N"))


@query("a9_mean_skipping_nulls", with_views("""
SELECT CAST(floor(row / 8) AS BIGINT) AS BLOCK, round(avg(PPTWT), 5) AS PPTWT, round(avg(TD), 5) AS TD, round(avg(MAT), 5) AS MAT FROM grid GROUP BY 1""", "grid"))
def a9(cat):
    return cat.grid.groupBy(F.floor(F.col("row") / 8).alias("BLOCK")).agg(*[rnd(F.avg(c), 5).alias(c) for c in ("PPTWT", "TD", "MAT")])


@query("a10_tally_having", with_views("""
SELECT ID, year(DATE) AS YEAR, count(*) AS N FROM obs_sparse GROUP BY ALL HAVING count(*) < 5""", "obs_sparse"))
def a10(cat):
    return cat.obs_sparse.groupBy("ID", F.year("DATE").alias("YEAR")).agg(F.count(F.lit(1)).alias("N")).where(F.col("N") < 5)


@query("w3_first_row", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, VALUE, k_order FROM (SELECT *, row_number() OVER (PARTITION BY ID
  ORDER BY DATE, k_order, k_line, k_part, k_supp) AS r FROM obs_sparse) WHERE r = 1""", "obs_sparse"))
def w3(cat):
    return rules.distinct_keep(cat.obs_sparse, ["ID"], OBS_ORDER).select("ID", day().alias("DAY"), "VALUE", "k_order")


@query("w4_group_count", with_views(f"""
SELECT {K}, count(*) OVER (PARTITION BY ID, year(DATE), month(DATE)) AS N FROM obs""", "obs"))
def w4(cat):
    w = Window.partitionBy("ID", F.year("DATE"), F.month("DATE"))
    return cat.obs.select(*KEY, F.count(F.lit(1)).over(w).alias("N"))


@query("w5_group_filter", with_views(f"""
SELECT {K} FROM obs_sparse WHERE ID IN (SELECT ID FROM obs_sparse GROUP BY ID HAVING sum(CASE WHEN VALUE <> 0 THEN 1 ELSE 0 END) >= 20)""", "obs_sparse"))
def w5(cat):
    enough = cat.obs_sparse.groupBy("ID").agg(F.sum(F.when(F.col("VALUE") != 0, 1).otherwise(0)).alias("n")).where(F.col("n") >= 20)
    return cat.obs_sparse.join(enough, "ID", "left_semi").select(*KEY)


@query("w6_group_median", with_views(f"""
SELECT ID, YEAR, MAX, round(median(MAX) OVER (PARTITION BY ID), 6) AS MEDIAN FROM (
  SELECT ID, {wy()} AS YEAR, max(VALUE) AS MAX FROM obs_sparse GROUP BY ALL)""", "obs_sparse"))
def w6(cat):
    ym = maxima.yearly_maximums(cat.obs_sparse, "ID", "DATE", "VALUE").select("ID", "YEAR", "MAX")
    return ym.join(ym.groupBy("ID").agg(rnd(F.median("MAX")).alias("MEDIAN")), "ID").select("ID", "YEAR", "MAX", "MEDIAN")


@query("t1_sorted_rows", with_views("SELECT ID, ELEMENT, VALUE, k_order, k_line FROM obs ORDER BY ID, DATE, VALUE DESC", "obs"))
def t1(cat):
    return cat.obs.orderBy("ID", "DATE", F.desc("VALUE")).select("ID", "ELEMENT", "VALUE", "k_order", "k_line")


@query("t2_top_rows", with_views("""
SELECT ID, k_order, k_line, VALUE FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY VALUE DESC, DATE, k_order, k_line,
  k_part, k_supp) AS r FROM obs) WHERE r <= 3""", "obs"))
def t2(cat):
    w = Window.partitionBy("ID").orderBy(F.desc("VALUE"), *OBS_ORDER)
    return cat.obs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3).select("ID", "k_order", "k_line", "VALUE")


@query("u1_union_missing_columns", with_views("""
SELECT ID, ELEVATION, NULL AS VALUE FROM stations UNION ALL SELECT ID, NULL, VALUE FROM obs""", "stations", "obs"))
def u1(cat):
    return cat.stations.select("ID", "ELEVATION").unionByName(cat.obs.select("ID", "VALUE"), allowMissingColumns=True)


@query("u3_distinct", with_views("SELECT DISTINCT STATE, COUNTY, ECO3 FROM stations", "stations"))
def u3(cat):
    return cat.stations.select("STATE", "COUNTY", "ECO3").distinct()


WIDE = """SELECT n_name AS STATE, 'C' || n_nationkey AS COUNTY, t.d AS DAYS, CASE WHEN t.d <= 3 THEN CAST(n_regionkey * 10 + t.d * 2 AS DOUBLE)
  ELSE t.d * (n_regionkey * 10 + 6) / CAST(3 AS DOUBLE) END AS v FROM nation, (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) t(d)"""


@query("h1_county_limits_long", with_views("SELECT STATE, COUNTY, DAYS, round(v, 6) AS COUNTY_MAX FROM wide", wide=WIDE))
def h1(cat):
    first = {c: (F.col("n_regionkey") * 10 + 2.0 * (i + 1)) for i, c in enumerate(reshape.DAY_COLUMNS[:3])}
    wide = cat.table("nation").select(F.col("n_name").alias("state"), F.concat(F.lit("C"), "n_nationkey").alias("county.name"),
                                      *[v.alias(k) for k, v in first.items()])
    return reshape.county_limits_long(reshape.extend_limits(wide)).withColumn("COUNTY_MAX", rnd("COUNTY_MAX"))


@query("h2_split_column", with_views("""
SELECT ID, CAST(split_part(ECO3, '.', 1) AS INTEGER) AS L1, CAST(split_part(ECO3, '.', 2) AS INTEGER) AS L2,
  CAST(split_part(ECO3, '.', 3) AS INTEGER) AS L3 FROM stations""", "stations"))
def h2(cat):
    return reshape.split_column(cat.stations.select("ID", "ECO3"), "ECO3", ["L1", "L2", "L3"], "\\.", ["int"] * 3)


# --- scalar functions ---------------------------------------------------------------------

@query("c4_unit_factors", with_views(f"""
SELECT {K}, round(VALUE * 0.0098064, 7) AS KPA_FROM_MM, round(VALUE * 0.09806665, 7) AS KPA_FROM_CM, round(VALUE * 25.4, 4) AS MM,
  round(VALUE * 20.89, 4) AS PSF FROM obs""", "obs"))
def c4(cat):
    v = F.col("VALUE")
    return cat.obs.select(*KEY, rnd(v * conv.MM_WATER_TO_KPA, 7).alias("KPA_FROM_MM"), rnd(v * conv.CM_WATER_TO_KPA, 7).alias("KPA_FROM_CM"),
                          rnd(v * conv.INCH_TO_MM, 4).alias("MM"), rnd(v * conv.KPA_TO_PSF, 4).alias("PSF"))


@query("c6_depth_only_load", with_views(f"""
SELECT {K}, round(CASE WHEN VALUE * 2 / 2.54 < 22 THEN 0.9 * 0.04788 * (VALUE * 2 / 2.54)
  ELSE (2.36 * (VALUE * 2 / 2.54) - 31.9) * 0.04788 END, 7) AS LOAD FROM obs""", "obs"))
def c6(cat):
    return cat.obs.select(*KEY, rnd(conv.rmcd_load(F.col("VALUE") * 2), 7).alias("LOAD"))


@query("c7_season_day", with_views(f"""
SELECT {K}, CAST(CASE WHEN d > 250 THEN CASE WHEN d = 366 THEN -1 ELSE d - 366 END ELSE d END AS INTEGER) AS DOYA
FROM (SELECT *, dayofyear(DATE) AS d FROM obs)""", "obs"))
def c7(cat):
    return cat.obs.select(*KEY, calendar.season_day("DATE").alias("DOYA"))


@query("c8_snow_month", with_views(f"""
SELECT {K}, CAST((month(DATE) + 3) % 12 AS INTEGER) AS SMONTH, round(CASE WHEN VALUE = 0 THEN 0 ELSE ln(VALUE) END, 6) AS LOGVALUE FROM obs""", "obs"))
def c8(cat):
    return cat.obs.select(*KEY, calendar.snow_month("DATE").alias("SMONTH"), rnd(calendar.log_or_zero("VALUE")).alias("LOGVALUE"))


@query("c10_parent_region", with_views("""
SELECT ID, split_part(ECO3, '.', 1) || '.' || split_part(ECO3, '.', 2) AS LEVEL2, split_part(ECO3, '.', 1) AS LEVEL1 FROM stations""", "stations"))
def c10(cat):
    two = labels.parent_region("ECO3")
    return cat.stations.select("ID", two.alias("LEVEL2"), labels.parent_region(two).alias("LEVEL1"))


@query("c12_round_half_even", with_views("""
SELECT ID, round_even(LATITUDE / 4, 1) AS LATITUDE, CAST(round_even(ELEVATION / 2, 0) AS INTEGER) AS ELEVATION,
  coalesce(try_cast(nullif(COUNTY, 'C0')[2:] AS BIGINT), 99999999) AS HUC FROM stations""", "stations"))
def c12(cat):
    code = F.when(F.col("COUNTY") != "C0", F.substring("COUNTY", 2, 9))
    return cat.stations.select("ID", F.bround(F.col("LATITUDE") / 4, 1).alias("LATITUDE"),
                               F.bround(F.col("ELEVATION") / 2, 0).cast("int").alias("ELEVATION"),
                               F.coalesce(code.try_cast("bigint"), F.lit(99999999).cast("bigint")).alias("HUC"))


@query("c14_mixed_dates", with_views(f"""
SELECT {K}, CASE WHEN ELEMENT = 'WESD' AND SFLAG = 'F' THEN NULL ELSE strftime(DATE, '%Y-%m-%d') END AS DAY FROM obs""", "obs"))
def c14(cat):
    text = (F.when(F.col("ELEMENT") == "SNWD", F.date_format("DATE", "yyyy-MM-dd"))
            .when(F.col("SFLAG") == "F", F.date_format("DATE", "dd MMM yyyy"))
            .otherwise(F.date_format("DATE", "M/d/yyyy")))
    return cat.obs.select(*KEY, day(labels.parse_mixed_date(text)).alias("DAY"))


@query("c16_state_names", with_views("""
SELECT c_custkey AS ID, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MA' WHEN c_mktsegment = 'BUILDING' THEN 'DC'
  WHEN c_mktsegment = 'FURNITURE' THEN 'FU' END AS STATE FROM customer"""))
def c16(cat):
    names = {"Machinery": "MA", "Furniture": "FU"}
    return cat.table("customer").select(F.col("c_custkey").alias("ID"), reshape.state_abbreviation(
        F.lower("c_mktsegment"), names, {"Building": "DC"}).alias("STATE"))


@query("c17_reviewer_tag", with_views("""
SELECT s_suppkey AS ID, CASE WHEN s_name LIKE '%7%' THEN 'first' WHEN s_name LIKE '%3%' THEN 'second' ELSE 'unknown' END AS name FROM supplier"""))
def c17(cat):
    return cat.table("supplier").select(F.col("s_suppkey").alias("ID"), labels.reviewer_tag(
        "s_name", {"first": "7", "second": "3"}).alias("name"))


# --- review lists --------------------------------------------------------------------------

MARK = "CASE WHEN VALUE > 45 THEN 1 WHEN VALUE = 0 THEN -1 ELSE 0 END"
NAMED = f"""SELECT ID, DATE, ELEMENT, VALUE, CAST(VALUE > 40 AS INTEGER) AS FLAGGED, {MARK} AS OUTLIER,
  CASE WHEN SFLAG = 'F' THEN 'first' ELSE 'second' END AS name, 'older' AS TYPE FROM obs"""
FRESH = """SELECT ID, DATE, ELEMENT, VALUE, 1 AS FLAGGED, CASE WHEN VALUE >= 42 THEN 1 ELSE 0 END AS OUTLIER, NULL AS name,
  'newer' AS TYPE FROM obs WHERE ELEMENT = 'WESD'"""


def named_list(cat):
    v = F.col("VALUE")
    return cat.obs.select("ID", "DATE", "ELEMENT", "VALUE", (v > 40).cast("int").alias("FLAGGED"),
                          F.when(v > 45, 1).when(v == 0, -1).otherwise(0).alias("OUTLIER"),
                          F.when(F.col("SFLAG") == "F", "first").otherwise("second").alias("name"),
                          F.lit("older").alias("TYPE"))


def fresh_list(cat):
    return cat.obs.where(F.col("ELEMENT") == "WESD").select(
        "ID", "DATE", "ELEMENT", "VALUE", F.lit(1).alias("FLAGGED"),
        F.when(F.col("VALUE") >= 42, 1).otherwise(0).alias("OUTLIER"), F.lit("newer").alias("TYPE"))


def strongest_sql(source: str, extra: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ID, DATE, ELEMENT, VALUE
      ORDER BY abs(OUTLIER) DESC, OUTLIER{extra}) AS r FROM {source}) WHERE r = 1"""


REVIEW_OUT = "SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, OUTLIER FROM "


def review_rows(df):
    return df.select("ID", day().alias("DAY"), "ELEMENT", "VALUE", "OUTLIER")


@query("u2_strongest_mark", with_views(REVIEW_OUT + "best", "obs", pool=f"{NAMED} UNION ALL {FRESH}",
                                       best=strongest_sql("pool", ", TYPE, FLAGGED")))
def u2(cat):
    both = named_list(cat).unionByName(fresh_list(cat), allowMissingColumns=True)
    return review_rows(reviews.strongest(both, ["name"]))


@query("c15_reconciled_marks", with_views(f"""
SELECT {K}, CASE WHEN SFLAG = 'F' THEN CASE WHEN VALUE > 45 THEN 1 ELSE 0 END ELSE -1 END AS OUTLIER FROM obs""", "obs"))
def c15(cat):
    two = cat.obs.select(*KEY, F.when(F.col("SFLAG") == "F", (F.col("VALUE") > 45).cast("int")).alias("OUTLIER"),
                         F.lit(-1).alias("Outlier_2"))
    return reviews.reconcile_outlier(two)


@query("p4_combined_outliers", with_views(
    "SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, OUTLIER, YEAR, TYPE FROM best", "obs",
    pool=f"SELECT *, year(DATE) AS YEAR FROM ({NAMED} UNION ALL {FRESH}) WHERE year(DATE) <> 1997 OR ELEMENT <> 'WESD'",
    best=strongest_sql("pool", ", TYPE, FLAGGED")))
def p4(cat):
    both = named_list(cat).unionByName(fresh_list(cat), allowMissingColumns=True)
    return review_plan.combined_outliers(both, 1997).select("ID", day().alias("DAY"), "ELEMENT", "VALUE", "OUTLIER", "YEAR", "TYPE")


ALTERNATE = {
    "fresh0": f"SELECT f.* FROM ({FRESH}) f WHERE NOT EXISTS (SELECT 1 FROM obs q WHERE q.QFLAG <> ' ' AND q.ID = f.ID "
              "AND q.DATE = f.DATE AND q.ELEMENT = f.ELEMENT) AND year(DATE) <> 1997",
    "fresh1": strongest_sql("fresh0", ", TYPE, FLAGGED"),
    "older": strongest_sql(f"({NAMED})", ", TYPE, FLAGGED, name"),
    "joined": """SELECT coalesce(a.ID, b.ID) AS ID, coalesce(a.DATE, b.DATE) AS DATE, coalesce(a.ELEMENT, b.ELEMENT) AS ELEMENT,
      coalesce(a.VALUE, b.VALUE) AS VALUE, a.name, coalesce(a.OUTLIER, 0) AS x, coalesce(b.OUTLIER, 0) AS y
      FROM older a FULL JOIN fresh1 b ON a.ID = b.ID AND a.DATE = b.DATE AND a.ELEMENT = b.ELEMENT AND a.VALUE = b.VALUE""",
    "alt0": """SELECT ID, DATE, ELEMENT, VALUE, CASE WHEN x <> 0 THEN x ELSE y END AS OUTLIER FROM joined
      WHERE (name = 'first' OR y <> 0 OR VALUE = 0 OR x <= 0) AND (x <> 0 OR y <> 0)""",
    "alt": strongest_sql("alt0"),
}


def _alternate(cat):
    older = reviews.strongest(named_list(cat), ["name"])
    return older, review_plan.alternate_outliers(older, fresh_list(cat), cat.obs, "first", 1997)


@query("p5_alternate_outliers", with_views(REVIEW_OUT + "alt", "obs", **ALTERNATE))
def p5(cat):
    return review_rows(_alternate(cat)[1])


@query("u4_list_differences", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, OUTLIER, 'first' AS SIDE FROM older WHERE OUTLIER <> 0
  AND (ID, DATE, ELEMENT, VALUE) NOT IN (SELECT ID, DATE, ELEMENT, VALUE FROM alt)
UNION ALL SELECT ID, strftime(DATE, '%Y-%m-%d'), ELEMENT, VALUE, OUTLIER, 'second' FROM alt WHERE OUTLIER <> 0
  AND (ID, DATE, ELEMENT, VALUE) NOT IN (SELECT ID, DATE, ELEMENT, VALUE FROM older)""", "obs", **ALTERNATE))
def u4(cat):
    older, alt = _alternate(cat)
    return reviews.differences(older, alt).select("ID", day().alias("DAY"), "ELEMENT", "VALUE", "OUTLIER", "SIDE")


@query("j6_suffixed_full_join", with_views("""
SELECT ID, strftime(DATE, '%Y-%m-%d') AS DAY, ELEMENT, VALUE, x AS OUTLIER_X, y AS OUTLIER_Y FROM joined""", "obs", **ALTERNATE))
def j6(cat):
    older = reviews.strongest(named_list(cat), ["name"])
    fresh = reviews.strongest(rules.drop_element_year(reviews.without_flagged(fresh_list(cat), cat.obs), "WESD", 1997))
    a = older.select(*reviews.KEYS, F.col("OUTLIER").alias("OUTLIER_X"))
    b = fresh.select(*reviews.KEYS, F.col("OUTLIER").alias("OUTLIER_Y"))
    both = a.join(b, reviews.KEYS, "full_outer").fillna(0, subset=["OUTLIER_X", "OUTLIER_Y"])
    return both.select("ID", day().alias("DAY"), "ELEMENT", "VALUE", "OUTLIER_X", "OUTLIER_Y")


@query("a10_outlier_counts", with_views("""
SELECT ID, year(DATE) AS YEAR, count(*) AS n FROM (SELECT * FROM best WHERE OUTLIER > 0) GROUP BY ALL""", "obs",
                                        best=strongest_sql(f"({NAMED})", ", TYPE, FLAGGED, name")))
def a10_outliers(cat):
    return reviews.yearly_counts(reviews.strongest(named_list(cat), ["name"]))


@query("p10_listed_station_year", with_views(f"""
SELECT {K} FROM obs WHERE NOT (ELEMENT = 'WESD' AND year(DATE) = 1997 AND ID IN (SELECT ID FROM stations WHERE STATE_MAX IS NULL))""",
                                             "obs", "stations"))
def p10(cat):
    listed = cat.stations.where(F.col("STATE_MAX").isNull())
    return reviews.drop_known_years(cat.obs, listed, 1997).select(*KEY)
