import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import calendar, labels
from firnline.operators import maxima, qc, rules

OBS = "ID string, DATE date, ELEMENT string, VALUE double, MFLAG string, QFLAG string, SFLAG string"


def day(text):
    return dt.date.fromisoformat(text)


def obs(spark, rows):
    full = [(i, day(d), e, v, m, q, None) for i, d, e, v, m, q in rows]
    return spark.createDataFrame(full, OBS)


def stations(spark, rows=(("a", "UT", "C1", 100.0), ("b", "UT", "C1", None))):
    return spark.createDataFrame(list(rows), "ID string, STATE string, COUNTY string, STATE_MAX double")


def limits(spark, base=10.0, step=5.0):
    return spark.createDataFrame([("UT", "C1", d, base + step * d) for d in range(1, 11)],
                                 "STATE string, COUNTY string, DAYS int, COUNTY_MAX double")


def test_all_means_three_rules(spark):
    rows = [("a", "2000-01-01", "SNWD", 1.0, None, None), ("a", "2000-01-02", "SNWD", 2.0, "P", None),
            ("a", "2000-01-03", "SNWD", 3.0, "T", "G"), ("a", "2000-07-04", "SNWD", 4.0, None, ""),
            ("a", "2000-02-05", "SNWD", 5.0, "", " "), ("a", "2000-02-06", "SNWD", 9e9, None, None)]
    got = sorted(r.VALUE for r in qc.clean_station_data(obs(spark, rows)).collect())
    assert got == [1.0, 5.0, 9e9]


def test_guards(spark):
    df = obs(spark, [("a", "2000-01-01", "SNWD", 1.0, None, None)])
    with pytest.raises(ValueError):
        qc.clean_station_data(df, ["high_max", "state_max"])
    with pytest.raises(ValueError):
        qc.clean_station_data(df, ["corrupt_years"])
    with pytest.raises(ValueError):
        qc.clean_station_data(df, ["corrupt_years"], yearly_threshold=0)
    with pytest.raises(ValueError):
        qc.clean_station_data(df, ["no_such_rule"])


def test_state_max(spark):
    rows = [("a", "2000-01-01", "SNWD", 101.0, None, None), ("a", "2000-01-01", "WESD", 499.0, None, None),
            ("a", "2000-01-02", "WESD", 501.0, None, None), ("b", "2000-01-01", "SNWD", 1e6, None, None),
            ("zz", "2000-01-01", "SNWD", 1e6, None, None), ("a", "2000-01-05", "SNWD", None, None, None)]
    got = qc.clean_station_data(obs(spark, rows), ["state_max"], stations=stations(spark))
    assert sorted((r.ID, r.ELEMENT) for r in got.collect()) == [
        ("a", "SNWD"), ("a", "WESD"), ("b", "SNWD"), ("zz", "SNWD")]


def brute_county(rows, limit):
    """Sequential rule for one station; rows sorted, one element; returns marks."""
    out, prev, year, flag = [], None, None, False
    for d, v in rows:
        wy = d.year + (d.month > 9)
        if wy != year:
            prev, year, flag = None, wy, False
        gap = 1 if prev is None else (d - prev[0]).days
        rise = v if prev is None else v - prev[1]
        if not (prev is not None and v == prev[1]):
            flag = gap in limit and rise > limit[gap]
        out.append(flag)
        prev = (d, v)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_county_max_against_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    days, start = [], day("1999-08-01")
    at = start
    while at < day("2001-06-01"):
        days.append(at)
        at += dt.timedelta(days=int(rng.choice([1, 1, 1, 2, 5, 12, 40])))
    # Long runs of equal values that cross month ends.
    vals, v = [], 0.0
    for _ in days:
        if rng.random() < 0.3:
            v = float(rng.choice([0, 10, 20, 40, 80, 200]))
        vals.append(v)
    limit = {d: 10.0 + 5 * d for d in range(1, 11)}
    want = brute_county(list(zip(days, vals)), limit)
    df = obs(spark, [("a", str(d), "SNWD", x, None, None) for d, x in zip(days, vals)])
    got = qc.above_county_max(df, stations(spark), limits(spark)).orderBy("DATE").collect()
    assert [r._above for r in got] == want
    assert any(want) and not all(want)


def test_county_max_duplicates_share_fate(spark):
    rows = [("a", "2000-01-01", "SNWD", 1.0, None, None)] + [("a", "2000-01-02", "SNWD", 90.0, None, None)] * 3
    got = qc.clean_station_data(obs(spark, rows), ["county_max"], stations=stations(spark),
                                county_maxes=limits(spark), order=("DATE", "VALUE"))
    assert [r.VALUE for r in got.collect()] == [1.0]


def test_high_max_keeps_well_attested_years(spark):
    rows = []
    for year in range(1990, 2002):
        rows.append(("a", f"{year}-01-10", "SNWD", float(40 + 8 * (year % 4)), None, None))
        rows.append(("b", f"{year}-01-10", "SNWD", float(40 + 8 * (year % 4)), None, None))
    rows.append(("a", "1995-02-01", "SNWD", 9000.0, None, None))
    rows += [("b", f"1995-02-0{d}", "SNWD", 9000.0 + d, None, None) for d in range(1, 6)]
    got = qc.clean_station_data(obs(spark, rows), ["high_max"])
    high = sorted(r.ID for r in got.where("VALUE > 8000").collect())
    assert high == ["b"] * 5
    # Identical yearly maxima: nothing can exceed the cutoff.
    flat = [("c", f"{y}-01-01", "SNWD", 5.0, None, None) for y in range(1990, 2000)]
    assert qc.clean_station_data(obs(spark, flat), ["high_max"]).count() == 10


def test_corrupt_years(spark):
    rows = [("a", f"2000-01-{d:02d}", "SNWD", 500.0 if d <= 5 else 1.0, None, None) for d in range(1, 11)]
    rows += [("a", f"2001-01-{d:02d}", "SNWD", 500.0 if d <= 1 else 1.0, None, None) for d in range(1, 11)]
    df, st = obs(spark, rows), stations(spark)
    half = qc.clean_station_data(df, ["state_max", "corrupt_years"], yearly_threshold=0.5, stations=st)
    assert half.count() == 9
    one = qc.clean_station_data(df, ["state_max", "corrupt_years"], yearly_threshold=1, stations=st)
    assert one.count() == 0
    both = qc.clean_station_data(df, ["state_max", "county_max", "corrupt_years"], yearly_threshold=6, stations=st,
                                 county_maxes=limits(spark))
    assert both.count() == 14


def test_anti_join_matches_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "a string, b int")
    gone = spark.createDataFrame([("x", None)], "a string, b int")
    assert [tuple(r) for r in rules.anti(df, gone).collect()] == [("y", 1)]


def test_calendar(spark):
    df = spark.createDataFrame([(day(d),) for d in ("1999-09-30", "1999-10-01", "2000-12-31", "1999-12-31", "2000-01-01")], "d date")
    got = df.select(calendar.water_year("d"), calendar.season_year("d"), calendar.season_day("d"), calendar.snow_month("d")).collect()
    assert [tuple(r) for r in got] == [(1999, 2000, -93, 0), (2000, 2000, -92, 1), (2001, 2001, -1, 3),
                                       (2000, 2000, -1, 3), (2000, 2000, 1, 4)]


def test_month_tokens(spark):
    df = spark.createDataFrame([("4:5:6",), ("",), (None,), ("a:4",), ("4:4",)], "s string")
    got = [r[0] for r in df.select(labels.relmonth_count("s", [2, 4, 6])).collect()]
    assert got == [2, 0, 0, 1, 2]


def test_region_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("6.2.1", "6.2.13", "6.21.1", "16.2.1", "6-2.1")], "c string")
    def hits(codes, exact=False):
        return sorted(r.c for r in df.where(labels.region_match("c", codes, exact)).collect())
    assert hits(["6"]) == ["6.2.1", "6.2.13", "6.21.1"]
    assert hits(["6.2"]) == ["6-2.1", "6.2.1", "6.2.13"]  # so does the dot inside a number
    assert hits(["6.2.1"]) == ["6-2.1", "6.2.1", "6.2.13"]  # a prefix, and a dot matches any character
    assert hits(["6.2.1"], exact=True) == ["6.2.1"]


def monthly(spark, rows):
    full = [(i, e, day(d), v) for i, e, d, v in rows]
    return spark.createDataFrame(full, "ID string, ELEMENT string, DATE date, VALUE double")


@pytest.mark.parametrize("n,months,top,prior", [(3, 3, 5.0, True), (4, 3, 99.0, False), (3, 4, 99.0, False)])
def test_priority_thresholds(spark, n, months, top, prior):
    rows = [("a", "WESD", "2000-01-01", 5.0), ("a", "WESD", "2000-02-01", 4.0), ("a", "WESD", "2000-03-01", 3.0),
            ("a", "SNWD", "1999-11-01", 99.0)]
    r = maxima.yearly_maximums(monthly(spark, rows), "ID", "DATE", "VALUE", value_type="ELEMENT", prioritize="WESD",
                               n=n, months=months).collect()
    assert len(r) == 1 and r[0].MAX == top and r[0].PRIORITIZED is prior
    assert r[0].MONTH_NAMES == "11:1:2:3"  # SNWD sorts before WESD
    assert r[0].MAX_N == (3 if prior else 4)


def test_priority_needs_a_positive_maximum(spark):
    rows = [("a", "WESD", f"2000-0{m}-01", 0.0) for m in (1, 2, 3)] + [("a", "SNWD", "2000-01-05", 7.0)]
    r = maxima.yearly_maximums(monthly(spark, rows), "ID", "DATE", "VALUE", value_type="ELEMENT", prioritize="WESD",
                               n=1, months=1).collect()[0]
    assert (r.MAX, r.PRIORITIZED, r.MAX_MONTHS) == (7.0, False, 3)


def test_monthly_maximum_ties_and_nulls(spark):
    rows = [("a", "SNWD", "2000-01-09", 5.0), ("a", "SNWD", "2000-01-03", 5.0), ("a", "SNWD", "2000-01-01", None)]
    r = maxima.monthly_maximums(monthly(spark, rows), "ID", "DATE", "VALUE").collect()
    assert len(r) == 1 and r[0].DATE == day("2000-01-03") and r[0].MAX_N == 3 and r[0].YEAR == 2000


def test_monthly_plan_aggregates_before_shuffle(spark):
    from firnline.catalog import Catalog
    cat = Catalog(spark, "/root/testdata/sf0.001")
    ym = maxima.yearly_maximums(qc.clean_station_data(cat.obs), "ID", "DATE", "VALUE", value_type="ELEMENT", prioritize="WESD")
    plan = ym._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_repeated_and_missing_county_limits(spark):
    from firnline.operators import qc
    stations = spark.createDataFrame([("a", "X", None), ("b", "X", "C")], "ID string, STATE string, COUNTY string")
    limits = spark.createDataFrame([("X", "C", 1, 9.0), ("X", "C", 1, 5.0), ("X", None, 1, 7.0), ("X", "C", None, 1.0)],
                                   "STATE string, COUNTY string, DAYS int, COUNTY_MAX double")
    got = {r.ID: r["_limits"] for r in qc.station_limits(stations, limits).collect()}
    assert got == {"a": {1: 7.0}, "b": {1: 5.0}}
