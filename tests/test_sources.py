import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from firnline.operators import reviews
from firnline.plans import reviews as review_plan
from firnline.sources import daily, manifest, scans, tables
from firnline.streaming import ingest


def line(station, ym, element, values):
    slots = "".join(f"{values.get(d, (-9999, '   '))[0]:>5}{values.get(d, (-9999, '   '))[1]}" for d in range(1, 32))
    return f"{station:<11}{ym}{element}{slots}"


@pytest.fixture
def folder(tmp_path):
    feb = line("US000000001", "200102", "SNWD", {1: (0, "  7"), 2: (-5, "T G"), 28: (12345, "P X"), 29: (3, "   ")})
    other = line("US000000001", "200102", "TMAX", {1: (10, "   ")})
    (tmp_path / "US000000001.dly").write_text(feb + "\n" + other + "\n")
    (tmp_path / "US000000002.dly").write_text(line("US000000002", "200012", "WESD", {31: (77, "   ")}) + "\n")
    (tmp_path / "US000000003.dly").write_text(line("US000000003", "200012", "TMAX", {31: (77, "   ")}) + "\n")
    return tmp_path


def test_daily_files(spark, folder):
    got = daily.get_station_data(spark, str(folder)).orderBy("ID", "DATE").collect()
    assert [(r.ID[-1], str(r.DATE), r.ELEMENT, r.VALUE, r.MFLAG, r.QFLAG, r.SFLAG) for r in got] == [
        ("1", "2001-02-01", "SNWD", 0.0, " ", " ", "7"), ("1", "2001-02-02", "SNWD", -5.0, "T", " ", "G"),
        ("1", "2001-02-28", "SNWD", 12345.0, "P", " ", "X"), ("2", "2000-12-31", "WESD", 77.0, " ", " ", " ")]
    one = daily.get_station_data(spark, str(folder), ["US000000002", "US000000009"])
    assert [r.ID for r in one.collect()] == ["US000000002"]
    empty = daily.get_station_data(spark, str(folder), ["US000000009"])
    assert empty.count() == 0 and empty.columns == ["ID", "DATE", "ELEMENT", "VALUE", "MFLAG", "QFLAG", "SFLAG"]
    asked = spark.createDataFrame([("US000000002",), ("US000000009",)], "ID string")
    assert [r.ID for r in daily.missing_files(spark, str(folder), asked).collect()] == ["US000000009"]
    st = spark.createDataFrame([("US000000002", "UT", "6.2.13")], "ID string, STATE string, ECO3 string")
    assert daily.get_state_data(spark, str(folder), st, ["UT"]).count() == 1
    assert daily.get_region_data(spark, str(folder), st, ["6.2"]).count() == 1
    assert scans.missing_stations(asked, daily.get_station_data(spark, str(folder))).count() == 1


def test_files_of_the_manifest_alone_are_opened(spark, folder, tmp_path):
    st = spark.createDataFrame([("US000000001", "UT", "1.1.1"), ("US000000002", "ID", "6.2.13"), ("US000000007", "ID", "6.2.13")], "ID string, STATE string, ECO3 string")
    named = daily.get_state_data(spark, str(folder), st, ["ID"])
    assert [r.ID for r in named.collect()] == ["US000000002"]
    files = daily.station_files(spark, str(folder))
    assert {r.ID for r in files.collect()} == {"US000000001", "US000000002", "US000000003"} and all(r.size > 0 for r in files.collect())
    rows = daily.files_data(files.where("ID = 'US000000001'"), path=True).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"US000000001.dly"} and len(rows) == 3
    # A file that went after it was listed is skipped; many small ones share a partition, each is read once.
    listed = [(f"{folder}/US{i:09d}.dly", f"US{i:09d}", 10) for i in (1, 2, 9)]
    assert daily.files_data(spark.createDataFrame(listed, "path string, ID string, size long")).count() == 4
    groups = manifest.packed(listed * 40, manifest.OPEN_BYTES * 10)
    assert sum(len(g.files) for g in groups) == 120 and max(len(g.files) for g in groups) <= 10 and len(groups) < 20
    assert manifest.packed([], 5)[0].files == []


def test_lines_across_chunks(tmp_path, monkeypatch):
    (tmp_path / "a.dly").write_bytes(b"one\r\ntwo\n\n" + b"x" * 50 + b"\nlast")
    for chunk in (1, 3, 7, 1000):
        monkeypatch.setattr(manifest, "CHUNK", chunk)
        assert [x for part in manifest.lines_of(str(tmp_path / "a.dly")) for x in part] == ["one", "two", "", "x" * 50, "last"]


def test_written_station_files(spark, folder, tmp_path):
    first = daily.get_station_data(spark, str(folder))
    daily.write_station_files(first, str(tmp_path / "out"))
    files = daily.station_files(spark, str(tmp_path / "out"), daily.WRITTEN_GLOB, daily.WRITTEN_NAME)
    assert sorted(r.ID for r in files.collect()) == ["US000000001", "US000000002"]
    assert sorted(map(tuple, daily.files_data(files).collect())) == sorted(map(tuple, first.collect()))


def test_daily_round_trip(spark, folder):
    first = daily.get_station_data(spark, str(folder), elements=("SNWD", "WESD", "TMAX"))
    again = daily.parse_daily_lines(daily.format_daily_lines(first), ("SNWD", "WESD", "TMAX"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_stream_equals_batch(spark, folder, tmp_path):
    st = spark.createDataFrame([("US000000001", 100.0)], "ID string, STATE_MAX double")
    from firnline.operators import qc
    batch = qc.clean_station_data(daily.get_station_data(spark, str(folder)), ["all", "state_max"], stations=st)
    q = (ingest.clean_stream(ingest.daily_stream(spark, str(folder)), st).writeStream.format("memory")
         .queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 3


def test_year_files(spark, tmp_path):
    with gzip.open(tmp_path / "1981.csv.gz", "wt") as f:
        f.write("A,19810101,SNWD,5,,,7,0700\nA,19810102,SNWD,-9999,,,7,\nA,19810103,TMAX,5,,,7,\n")
    (tmp_path / "1983.csv").write_text("B,19830101,WESD,6,P,G,7,\n")
    got = tables.get_year_data(spark, str(tmp_path), [1981, 1982, 1983], spread=2).orderBy("ID").collect()
    assert [(r.ID, str(r.DATE), r.VALUE, r.QFLAG) for r in got] == [("A", "1981-01-01", 5.0, None), ("B", "1983-01-01", 6.0, "G")]
    assert [r.YEAR for r in tables.missing_years(spark, str(tmp_path), [1981, 1982]).collect()] == [1982]


def test_inventory(spark, tmp_path):
    text = "".join(v.ljust(w) if w in (11, 31, 3) else v.rjust(w) for v, w in zip(
        ["ACW00011604", "17.1167", "-61.7833", "10.1", " ", " ST JOHNS", "", "", "12345"], tables.INVENTORY_WIDTHS))
    (tmp_path / "s.txt").write_text(text + "\n")
    r = tables.read_inventory(spark, str(tmp_path / "s.txt")).first()
    assert (r.ID, r.LATITUDE, r.LONGITUDE, r.ELEVATION, r.STATE, r.NAME, r.GSN_FLAG, r.WMO_ID) == (
        "ACW00011604", 17.1167, -61.7833, 10.1, None, "ST JOHNS", None, "12345")


def test_review_lists(spark, tmp_path):
    (tmp_path / "UT_Outliers.csv").write_text(
        "ID,DATE,ELEMENT,VALUE,FLAGGED,OUTLIER\nA,2000-01-02,SNWD,5,1,0\nA,1952-01-02,WESD,5,1,1\nB,2000-03-04,SNWD,0,0,-1\n")
    (tmp_path / "CO_Outliers.csv").write_text("ID,DATE,ELEMENT,VALUE,Outlier\nA,1/2/2000,SNWD,5,1\nC,bad,SNWD,5,1\n")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    lists = review_plan.read_lists(spark, str(tmp_path), {"state_flag": "Outliers\\.csv$"}, {"first": "^UT", "second": "^CO"})
    got = review_plan.combined_outliers(lists).orderBy("ID").collect()
    assert [(r.ID, str(r.DATE), r.OUTLIER, r.name, r.YEAR) for r in got] == [
        ("A", "2000-01-02", 1, "second", 2000), ("B", "2000-03-04", -1, "first", 2000), ("C", "None", 1, "second", None)]
    assert sorted((tuple(r) for r in reviews.yearly_counts(review_plan.combined_outliers(lists)).collect())) == [("A", 2000, 1), ("C", None, 1)]
    with pytest.raises(FileNotFoundError):
        review_plan.read_lists(spark, str(tmp_path), {"x": "nothing"})


def test_alternate_list_rules(spark):
    s = "ID string, DATE date, ELEMENT string, VALUE double, FLAGGED int, OUTLIER int"
    d = dt.date(2000, 1, 1)
    older = spark.createDataFrame([("a", d, "SNWD", 1.0, 1, 1, "me"), ("b", d, "SNWD", 1.0, 1, 1, "you"), ("c", d, "SNWD", 0.0, 1, 1, "you"),
                                   ("d", d, "SNWD", 1.0, 1, -1, "you"), ("e", d, "SNWD", 1.0, 1, 0, "me"), ("f", d, "SNWD", 1.0, 1, 1, "you")],
                                  s + ", name string")
    fresh = spark.createDataFrame([("f", d, "SNWD", 1.0, 1, -1), ("g", d, "SNWD", 1.0, 1, 1), ("h", d, "SNWD", 1.0, 1, 0)], s)
    got = {r.ID: r.OUTLIER for r in reviews.alternate_list(older, fresh, "me").collect()}
    assert got == {"a": 1, "c": 1, "d": -1, "f": 1, "g": 1}


def test_observation_table_prunes_folders(spark, tmp_path):
    obs = spark.createDataFrame([("a", dt.date(2000, 1, d), e, 1.0) for d in (1, 2) for e in ("SNWD", "WESD")],
                                "ID string, DATE date, ELEMENT string, VALUE double")
    tables.save_observations(obs, str(tmp_path / "t"))
    back = scans.element_scan(tables.read_table(spark, str(tmp_path / "t")), ["SNWD"])
    assert back.count() == 2
    assert "PartitionFilters: [" in back._jdf.queryExecution().executedPlan().toString()


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "ID string, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "ID string, v double").collect())) == [("a", 1.5), ("b", None)]


def test_written_years(spark, folder, tmp_path):
    first = daily.get_station_data(spark, str(folder))
    tables.write_year_data(first, str(tmp_path / "years"))
    names = {p.name for p in (tmp_path / "years").iterdir() if not p.name.startswith(".")}
    assert names == {f"{r.DATE.year}.csv.gz" for r in first.collect()}
    years = sorted(int(n[:4]) for n in names)
    back = tables.get_year_data(spark, str(tmp_path / "years"), years)
    assert sorted((r.ID, r.DATE, r.VALUE) for r in back.collect()) == sorted((r.ID, r.DATE, r.VALUE) for r in first.collect())
    assert [r.YEAR for r in tables.missing_years(spark, str(tmp_path / "years"), [*years, 1850]).collect()] == [1850]
