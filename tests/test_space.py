import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import geodesy as geo
from firnline.operators import cluster, grid, regional, spatial
from firnline.sources import tables

RING = "region_id string, poly_id int, ring_id int, points array<struct<x: double, y: double>>"


def edges(spark, rings):
    return tables.polygon_edges(spark.createDataFrame(rings, RING))


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)],
                                 "ID long, LONGITUDE double, LATITUDE double, ELEVATION double")


def km(a, b, radius=geo.PAIR_RADIUS_KM):
    (lo1, la1), (lo2, la2) = np.radians(a), np.radians(b)
    h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(h))


def brute_linkage(score, size, h, method):
    """Nearest pair first, linkage from the member distances: an independent definition."""
    s = score ** 2 if method == "ward.D2" else score
    top = h * h if method == "ward.D2" else h
    groups = [[i] for i in range(len(s))]
    weight = [{i: 1.0} for i in range(len(s))]

    def dist(a, b):
        block = s[np.ix_(groups[a], groups[b])]
        m = np.outer(size[groups[a]], size[groups[b]])
        if method == "single":
            return block.min()
        if method == "complete":
            return block.max()
        if method == "mcquitty":
            return sum(weight[a][i] * weight[b][j] * s[i, j] for i in groups[a] for j in groups[b])
        cross = (block * m).sum() / m.sum()
        if method == "average":
            return cross
        def inner(g):
            w = np.outer(size[g], size[g])
            return (s[np.ix_(g, g)] * w).sum() / w.sum()
        na, nb = size[groups[a]].sum(), size[groups[b]].sum()
        return 2 * na * nb / (na + nb) * (cross - inner(groups[a]) / 2 - inner(groups[b]) / 2)

    while len(groups) > 1:
        d, a, b = min((dist(a, b), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if d > top:
            break
        groups[a] += groups[b]
        weight[a] = {k: v / 2 for k, v in {**weight[a], **weight[b]}.items()}
        del groups[b], weight[b]
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("method", cluster.REDUCIBLE)
def test_clusters_against_definition(spark, method):
    rng = np.random.default_rng(3)
    base = np.column_stack([rng.uniform(-110, -108.5, 14), rng.uniform(40, 41.5, 14), rng.uniform(1000, 1600, 14)])
    rows = np.vstack([base, base[:4], base[:2]])  # copies of some places
    df = points(spark, rows)
    want_places = brute_linkage(
        np.array([[km(a[:2], b[:2]) / 40 + abs(a[2] - b[2]) / 300 for b in base] for a in base]),
        np.array([1.0 + (i < 4) + (i < 2) for i in range(14)]), 1.6, method)
    want = sorted(sorted(g + [14 + i for i in g if i < 4] + [18 + i for i in g if i < 2]) for g in want_places)
    assert 1 < len(want) < 14
    got = cluster.cluster_stations(df, 40, 300, 1.6, method).toPandas()
    assert sorted(sorted(g.ID.tolist()) for _, g in got.groupby("CLUST")) == want
    first = got.groupby("CLUST").ID.min().sort_index()
    assert list(first.index) == list(range(1, len(first) + 1)) and first.is_monotonic_increasing


def test_cluster_groups_and_errors(spark):
    df = points(spark, [(0, 0, 0), (0, 0, 0), (0, 0.01, 0), (5, 5, 5)]).withColumn("G", F.when(F.col("ID") < 2, "x").otherwise("y"))
    got = {r.ID: r.CLUST for r in cluster.cluster_stations(df, 1, 10, 2, group="G", label=True).collect()}
    assert got == {0: "x.0001", 1: "x.0001", 2: "y.0001", 3: "y.0002"}
    for m in ("nearest", "centroid"):
        with pytest.raises(ValueError):
            cluster.cluster_stations(df, 1, 1, 1, m)
    with pytest.raises(Exception, match="station without"):
        cluster.cluster_stations(df.withColumn("ELEVATION", F.lit(None).cast("double")), 1, 1, 1).collect()


def test_pairs_across_cells_pole_and_date_line(spark):
    df = points(spark, [(179.99, 0, 0), (-179.99, 0, 10), (0, 89.99, 0), (180, 89.99, 0), (50, 50, 0)])
    got = sorted((r.ID1, r.ID2) for r in spatial.close_pairs(df, 3, 20).collect())
    assert got == [(0, 1), (2, 3)]


def test_polygon_with_hole_and_two_parts(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    e = edges(spark, [("r", 1, 1, sq(0.0, 10.0)), ("r", 1, 2, sq(4.0, 6.0)), ("r", 2, 1, sq(20.0, 21.0)), ("q", 1, 1, sq(5.0, 30.0))])
    p = points(spark, [(1, 1, 0), (5, 5.5, 0), (20.5, 20.5, 0), (-1, 5, 0), (0, 0, 0), (10, 5, 0)])
    got = {(r.LONGITUDE, r.LATITUDE, r.region_id) for r in spatial.point_in_polygon(p, e).collect()}
    assert got == {(1, 1, "r"), (20.5, 20.5, "r"), (20.5, 20.5, "q"), (5, 5.5, "q"), (0, 0, "r"), (10, 5, "q")}


def test_regional_distance_against_samples(spark):
    rng = np.random.default_rng(5)
    tri = [[(-100.0, 35.0), (-95.0, 36.0), (-97.0, 40.0)], [(-80.0, 30.0), (-79.0, 30.5), (-79.5, 31.0)], [(-110.0, 45.0), (-109.0, 45.0), (-109.5, 46.0)]]
    e = edges(spark, [("a", 1, 1, tri[0]), ("a", 2, 1, tri[1]), ("b", 1, 1, tri[2])])
    rows = np.column_stack([rng.uniform(-115, -75, 60), rng.uniform(28, 48, 60), np.zeros(60)])
    got = {(r.ID, r.region_id): r.dist_km for r in spatial.regional_distance(points(spark, rows), e, "ID").collect()}
    assert len(got) == 120 and min(got.values()) >= 0

    def unit(p):
        lo, la = np.radians(p[0]), np.radians(p[1])
        return np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])

    t = np.linspace(0, 1, 4001)[:, None]
    arcs = []
    for ring in tri:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            v = (1 - t) * unit(a) + t * unit(b)
            arcs.append(v / np.linalg.norm(v, axis=1)[:, None])
    regions = {"a": np.vstack(arcs[:6]), "b": np.vstack(arcs[6:])}
    for i, r in enumerate(rows):
        for name, curve in regions.items():
            d = 2 * geo.POLYGON_RADIUS_KM * np.arcsin(np.linalg.norm(curve - unit(r), axis=1).min() / 2)
            assert got[i, name] == 0 or got[i, name] == pytest.approx(d, abs=0.2)
    near = {(r.ID, r.region_id): r.dist_km for r in spatial.regional_distance(points(spark, rows), e, "ID", max_dist=200).collect()}
    assert {k: v for k, v in near.items()} == pytest.approx({k: got[k] for k in near})
    assert {i for i, _ in near} == set(range(60)) and len(near) < 120


def test_bilinear_edges(spark):
    cells = spark.createDataFrame([(r, c, float(c), float(r), float(r * 10 + c) if (r, c) != (2, 2) else None)
                                   for r in range(3) for c in range(3)], "row long, col long, x double, y double, v double")
    spec = grid.GridSpec(0, 0, 1, 1)
    p = points(spark, [(0.5, 0.25, 0), (1.5, 1.5, 0), (2.5, 0.5, 0)])
    got = [r.v for r in grid.bilinear(p, cells, spec, ["v"]).orderBy("ID").collect()]
    assert got == [pytest.approx(3.0), None, None]
    assert [r.v for r in grid.cell_sample(p, cells, spec, ["v"]).orderBy("ID").collect()][0] in (0.0, 1.0)


def test_regional_model_roundtrip(spark):
    rng = np.random.default_rng(1)
    sq = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    e = edges(spark, [("a", 1, 1, sq(0.0)), ("b", 1, 1, sq(2.0)), ("empty", 1, 1, sq(50.0))])
    rows = np.column_stack([rng.uniform(0, 4, 80), rng.uniform(0, 2, 80), rng.uniform(0, 3000, 80)])
    slope = np.where(rows[:, 0] < 2, 0.5, -0.25)
    data = spark.createDataFrame([(i, *map(float, r), float(7 + s * r[2])) for i, (r, s) in enumerate(zip(rows, slope))],
                                 "ID long, LONGITUDE double, LATITUDE double, ELEVATION double, y double")
    m = regional.regional_model(data, e, "ID", buffer=1e-6, y="y", x=["ELEVATION"])
    coef = {r.region_id: r.coef for r in m.models.collect()}
    assert set(coef) == {"a", "b"}
    assert coef["a"] == pytest.approx([7, 0.5]) and coef["b"] == pytest.approx([7, -0.25])
    pred = {r.ID: r.prediction for r in m.predict(data, "ID", 1e-3).collect()}
    assert len(pred) == 80
    for i, r in enumerate(rows):
        if abs(r[0] - 2) > 0.01:
            assert pred[i] == pytest.approx(7 + slope[i] * r[2])

    def fit(pdf):
        if pdf.LONGITUDE.mean() > 2:
            raise RuntimeError("no")
        return len(pdf)

    f = regional.regional_model(data, e, "ID", buffer=1e-6, fit=fit, predict=lambda n, pdf: [float(n)] * len(pdf))
    bad = {r.region_id: r.error for r in f.models.collect()}
    assert bad["a"] is None and "RuntimeError" in bad["b"]
    # A row far from all usable regions takes the nearest one.
    assert f.predict(data, "ID", {"a": 5.0}).count() == 80
    for smooth in ({"b": 5.0}, {"a": 5.0, "nowhere": 1.0}):
        with pytest.raises(ValueError, match="smooth"):
            f.predict(data, "ID", smooth)
    with pytest.raises(ValueError, match="buffer lacks"):
        regional.regional_model(data, e, "ID", buffer={"a": 1.0, "b": 1.0}, y="y", x=["ELEVATION"])
    few = regional.membership(spatial.regional_distance(data, e, "ID"), "ID", 1e-6, min_n=70)
    assert {r.region_id: r["count"] for r in few.groupBy("region_id").count().collect()} == {"a": 70, "b": 70}


def ray_parity(places, edge_rows):
    """Crossings to the right of each place, by the plain rule."""
    out = set()
    for x, y in places:
        odd = {}
        for r, p, x1, y1, x2, y2 in edge_rows:
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd[r, p] = odd.get((r, p), 0) ^ 1
        out |= {(x, y, *k) for k, v in odd.items() if v}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cover_of_cells_gives_the_plain_parity(spark, seed):
    r = np.random.default_rng(seed)
    rings, n = [], 0
    for name, (cx, cy, radius) in {"a": (10, 20, 30), "b": (-3.3, 2.7, 0.4), "c": (50, -10, 7), "d": (10.5, 20.25, 3)}.items():
        for part in (1, 2):
            for ring, share in ((1, 1.0), (2, 0.4)):
                angle = np.sort(r.uniform(0, 2 * np.pi, 5 if part == 1 else 40))
                far = radius * share * r.uniform(0.5, 1, len(angle))
                step = 0.25 if seed == 2 else 1e-9  # many coordinates on lines of cells
                xy = [(round((cx + 2 * radius * (part - 1) + f * np.cos(a)) / step) * step, round((cy + f * np.sin(a)) / step) * step) for a, f in zip(angle, far)]
                rings.append((name, part, ring, xy))
                n += len(xy)
    edge_table = edges(spark, rings)
    rows = [(e.region_id, e.poly_id, e.x1, e.y1, e.x2, e.y2) for e in edge_table.collect()]
    places = {(float(x), float(y)) for _, _, x, y, _, _ in rows} | {((a + c) / 2, (b + d) / 2) for _, _, a, b, c, d in rows}
    places |= {(float(x), float(y)) for x, y in zip(r.uniform(-30, 90, 300), r.uniform(-25, 55, 300))}
    places |= {(float(x), float(y)) for x, y in zip(r.integers(-30, 90, 200) / 2, r.integers(-25, 55, 200) / 2)}
    places |= {(x, float(y)) for x, _ in list(places)[:40] for y in (1.0, 20.0, 20.25)}
    df = points(spark, [(x, y, 0.0) for x, y in places])
    got = {(p.LONGITUDE, p.LATITUDE, p.region_id, p.poly_id) for p in spatial.point_in_polygon(df, edge_table).collect()}
    assert got == ray_parity(places, rows) and len({g[2:] for g in got}) == 8


def test_far_polygons_of_one_band_do_not_meet(spark):
    angle = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    rings = [(name, 1, 1, [(float(x + 5 * np.cos(a)), float(40 + 5 * np.sin(a))) for a in angle]) for name, x in (("west", -110.0), ("east", 100.0))]
    r = np.random.default_rng(1)
    df = points(spark, np.column_stack([r.uniform(-116, -104, 2000), r.uniform(34, 46, 2000), np.zeros(2000)]))
    inner, local, border = spatial.polygon_cover(edges(spark, rings))
    assert inner.count() + border.count() < 2 * 40 ** 2
    size = local.first()["_size"]
    cells = df.select(F.floor(F.col("LONGITUDE") / size).alias("i"), F.floor(F.col("LATITUDE") / size).alias("j"))
    met = cells.join(local, ["i", "j"])
    assert met.where("region_id = 'east'").count() == 0 and met.count() < 2000 * 800 / 50
    inside = spatial.point_in_polygon(df, edges(spark, rings))
    assert {p.region_id for p in inside.collect()} == {"west"}


def test_pairs_are_met_once(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(x), float(y), float(e), "g" if i % 5 else None) for i, (x, y, e) in enumerate(zip(r.uniform(-180, 180, 400), r.uniform(-90, 90, 400), r.uniform(0, 900, 400)))]
    rows += [(1000 + i, *q[1:]) for i, q in enumerate(rows[:20])] + [(2000, 179.99, 10.0, 5.0, "g"), (2001, -179.99, 10.0, 5.0, "g")]
    df = spark.createDataFrame(rows, "ID long, LONGITUDE double, LATITUDE double, ELEVATION double, G string")
    got = [(p.ID1, p.ID2) for p in spatial.close_pairs(df, 900, 300, match=["G"]).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[4] == b[4] and abs(a[3] - b[3]) <= 300 and km(a[1:3], b[1:3]) <= 900}
    assert len(got) == len(set(got)) and set(got) == want
    base, cells = spatial._cells(df, 900, 300, "ELEVATION", "LONGITUDE", "LATITUDE", geo.PAIR_RADIUS_KM)
    met = spatial.half_pairs(base.withColumn("_r", F.lit(1)), cells, "ID", 900 / geo.PAIR_RADIUS_KM, ["G"])
    plain = spatial.pairs_within(base, base, cells, ["G"]).where("ID != r_ID")
    assert 2 * met.count() <= plain.count()


def test_models_from_parts_equal_those_of_whole_regions(spark, monkeypatch):
    class Failing(regional.GroupMedian):
        def update(self, state, rows):
            if (rows["VALUE"] == 13).any():
                raise ValueError("thirteen")
            return super().update(state, rows)

    r = np.random.default_rng(5)
    values = [(i, "big" if i % 3 else f"r{i % 7}", None if i % 11 == 0 else float(r.integers(0, 40) if i % 3 else r.normal())) for i in range(4000)]
    values = [(i, g, 14.0 if v == 13 else v) for i, g, v in values] + [(9000, "bad", 13.0), (9001, "bad", 1.0), (9002, "none", None)]
    df = spark.createDataFrame(values, "ID long, region_id string, VALUE double")
    data, members = df.select("ID", "VALUE").repartition(90), df.select("ID", "region_id")
    monkeypatch.setattr(regional, "FAN", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that there are many partitions to merge
    try:
        got = {m.region_id: m for m in regional.mergeable_models(data, members, "ID", Failing("VALUE")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert set(got) == {g for _, g, _ in values}
    for g in got:
        mine = [v for _, h, v in values if h == g]
        assert got[g].n_train == len(mine)
        if g in ("bad", "none"):
            assert got[g].model is None and got[g].error.startswith("ValueError: thirteen" if g == "bad" else "IndexError")
        else:
            assert pickle.loads(got[g].model) == pytest.approx(np.median([v for v in mine if v is not None])) and got[g].error is None
    models = regional.mergeable_models(data, members, "ID", Failing("VALUE"))
    out = regional.function_predictions(df.select("ID", "region_id"), models, "ID", lambda m, rows: [m + 0 * len(rows)] * len(rows), 100).collect()
    assert len(out) == 4000 and {p.region_id for p in out} == set(got) - {"bad", "none"}


def test_training_rows_by_growing_radius_equal_those_of_all_distances(spark):
    r = np.random.default_rng(8)
    df = points(spark, np.column_stack([r.uniform(-125, -65, 300), r.uniform(25, 50, 300), np.zeros(300)]))
    boxes = {"full": (-110, 30, -90, 45), "tiny": (-80.2, 40, -80, 40.2), "empty": (60, -10, 61, -9)}
    table = edges(spark, [(n, 1, 1, [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]) for n, (a, b, c, d) in boxes.items()])
    far = spatial.regional_distance(df, table, "ID")
    buffer = {"full": 10, "tiny": 500, "empty": 1}
    want = {tuple(x) for x in regional.membership(far, "ID", buffer, 25).select("region_id", "ID").collect()}
    got = [tuple(x) for x in regional.training_rows(df, table, "ID", buffer, 25).collect()]
    assert set(got) == want and len(got) == len(want)
    nearest = {tuple(x) for x in regional.nearest_rows(far, "ID", 7).select("region_id", "ID").collect()}
    assert {tuple(x) for x in regional.training_rows(df, table, "ID", 0, 7, need_inside=False).collect()} == nearest and len(nearest) == 21


def test_radius_means_take_the_smallest_radius_of_each_variable(spark):
    r = np.random.default_rng(6)
    cells = [(float(x), float(y), float(x * y) if x % 3 else None, float(x + y) if x > 45 else None) for x in range(40, 50) for y in range(40, 50)]
    grid_table = spark.createDataFrame(cells, "x double, y double, a double, b double")
    places = np.column_stack([r.uniform(40, 50, 60), r.uniform(40, 50, 60), np.zeros(60)])
    df = points(spark, np.vstack([places, places[:5], [[-100, 10, 0]]]))
    got = {p.ID: (p.a, p.b) for p in grid.radius_means(df, grid_table, ["a", "b"], [400000, 60000, 130000]).collect()}
    assert len(got) == 66 and got[65] == (None, None)
    for i, p in enumerate(np.vstack([places, places[:5]])):
        for k, v in ((2, got[i][0]), (3, got[i][1])):
            want = None
            for radius in (60, 130, 400):
                near = [c[k] for c in cells if c[k] is not None and km(p[:2], c[:2]) <= radius]
                if near:
                    want = np.mean(near)
                    break
            assert v == (None if want is None else pytest.approx(want))


def test_settled_places_do_not_meet_cells_of_larger_radii(spark, monkeypatch):
    met = []
    plain = grid.pairs_within
    monkeypatch.setattr(grid, "pairs_within", lambda left, right, *a, **k: met.append(left.count()) or plain(left, right, *a, **k))
    cells = spark.createDataFrame([(float(x), float(y), 1.0) for x in range(40, 50) for y in range(40, 50)], "x double, y double, a double")
    df = points(spark, [(40.01, 40.01, 0), (45.01, 45.01, 0), (49.0, 51.5, 0)])
    grid.radius_means(df, cells, ["a"], [10000, 400000]).count()
    assert met == [3, 1]


def test_nearest_cell_near_and_far_from_the_grid(spark, monkeypatch):
    r = np.random.default_rng(9)
    cells = [(i // 20, i % 20, 170.0 + i % 20, -10.0 + i // 20, float(i) if i % 4 else None) for i in range(400)]  # across the date line
    table = spark.createDataFrame(cells, "row long, col long, x double, y double, v double")
    places = np.vstack([np.column_stack([r.uniform(171, 188, 80), r.uniform(-9, 8, 80), np.zeros(80)]),
                        [[0, 89, 0], [10, -60, 0], [-170.3, 4.1, 0], [171.5, 0.5, 0]]])
    df = points(spark, np.vstack([places, places[:9]])).union(spark.createDataFrame([(500, None, 1.0, 1.0)], "ID long, LONGITUDE double, LATITUDE double, ELEVATION double"))
    descended, plain = [], grid.nearest
    monkeypatch.setattr(grid, "nearest", lambda p, *a, **k: descended.append(p.count()) or plain(p, *a, **k))
    rows = grid.nearest_cell(df, table, ["v"]).collect()
    got = {p.ID: p.v for p in rows}
    assert len(rows) == len(got) == 94 and got[500] is None
    assert descended and 1 <= descended[0] <= 2  # the others have a cell at hand
    for i, p in enumerate(np.vstack([places, places[:9]])):
        far = [round(km(p[:2], c[2:4]), 7) for c in cells]
        assert got[i] == min((d, c[0], c[1], c[4]) for d, c in zip(far, cells) if d == min(far))[3], i
