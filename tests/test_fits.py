import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import extremes, loads, numerics
from firnline.operators import fitting, reshape

rng = np.random.default_rng(7)
SAMPLES = {
    "lnorm": np.exp(rng.normal(2, 0.5, 4000)),
    "exp": rng.exponential(4, 4000),
    "gamma": rng.gamma(3, 2, 4000),
    "gumbel": 10 - 3 * np.log(rng.exponential(1, 4000)),
    "gev": 10 + 3 * (rng.exponential(1, 4000) ** -0.15 - 1) / 0.15,
    "weibull": 5 * rng.weibull(1.7, 4000),
}


@pytest.fixture(scope="module")
def maxima(spark):
    rows = [(k, float(v)) for k, xs in SAMPLES.items() for v in xs]
    rows += [("zeros", 0.0)] * 60 + [("one", 3.0)] + [("constant", 4.0)] * 30 + [("none", None)] * 5
    return spark.createDataFrame(rows, "ID string, MAX double").cache()


def fit(df, *args, **kw):
    return {r.ID: r for r in fitting.fit_dist(df, "ID", "MAX", *args, **kw).collect()}


def test_recovers_parameters(maxima):
    assert fit(maxima, "lnorm")["lnorm"].PAR1 == pytest.approx(2, abs=0.05)
    assert fit(maxima, "exp")["exp"].PAR1 == pytest.approx(0.25, rel=0.06)
    g = fit(maxima, "gamma")["gamma"]
    assert (g.PAR1, g.PAR2) == (pytest.approx(3, rel=0.1), pytest.approx(0.5, rel=0.1))
    g = fit(maxima, "gumbel")["gumbel"]
    assert (g.PAR1, g.PAR2) == (pytest.approx(10, abs=0.2), pytest.approx(3, abs=0.15))
    for method in ("mle", "lmoments"):
        g = fit(maxima, "gev", method)["gev"]
        assert (g.PAR1, g.PAR2, g.PAR3) == (pytest.approx(10, abs=0.25), pytest.approx(3, abs=0.2), pytest.approx(0.15, abs=0.05))
        assert g.EVENT50 == pytest.approx(10 + 3 * ((-math.log(0.98)) ** -0.15 - 1) / 0.15, rel=0.08)


@pytest.mark.parametrize("distr,method", [(d, m) for d, ms in fitting.METHODS.items() for m in ms])
def test_degenerate_groups(maxima, distr, method):
    r = fit(maxima, distr, method)
    assert r["zeros"].EVENT50 == 0 and r["zeros"].PROP_ZERO == 1 and r["zeros"].PAR1 is None
    assert r["one"].PAR1 is None and r["one"].NFIT == 1
    assert r["none"].NFIT == 0 and r["none"].EVENT50 is None
    assert set(r) == set(SAMPLES) | {"zeros", "one", "constant", "none"}


@pytest.mark.parametrize("distr", ["gumbel", "gev"])
def test_large_groups_by_passes_agree(maxima, distr):
    some = maxima.where(F.col("ID").isin("gev", "gumbel", "constant"))
    small, large = fit(some, distr), fit(some, distr, small_group=100)
    for k in ("gev", "gumbel"):
        for p in ("PAR1", "PAR2", "PAR3", "EVENT50"):
            a, b = getattr(small[k], p), getattr(large[k], p)
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-5, abs=1e-5)


def test_likelihood_is_at_its_maximum(maxima):
    g = fit(maxima, "gev")["gev"]
    x = SAMPLES["gev"]

    def nll(loc, scale, shape):
        t = (1 + shape * (x - loc) / scale) ** (-1 / shape)
        return len(x) * math.log(scale) - ((1 + shape) * np.log(t)).sum() + t.sum()

    best = nll(g.PAR1, g.PAR2, g.PAR3)
    for d in np.eye(3) * 0.01:
        for s in (1, -1):
            assert best <= nll(*(np.array([g.PAR1, g.PAR2, g.PAR3]) + s * d))


def test_fixed_shape(spark):
    df = spark.createDataFrame([("a", float(v), 0.2) for v in SAMPLES["gev"][:200]], "ID string, MAX double, SHAPE double")
    r = fitting.fit_dist(df, "ID", "MAX", "gev", shape="SHAPE").first()
    assert r.PAR3 == pytest.approx(0.2) and r.PAR2 > 0


def test_unknown_combinations(maxima):
    for d, m in (("gumbel", "mme"), ("gev", "mme"), ("norm", "mle"), ("exp", "regression")):
        with pytest.raises(ValueError):
            fitting.fit_dist(maxima, "ID", "MAX", d, m)


def test_ranks_against_sort(spark):
    x = np.round(rng.gamma(2, 5, 3000), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x], "ID string, v0 double")
    got = fitting.ranked_counts(fitting.value_counts(df, ["ID"], "v0"), ["ID"]).orderBy("v").toPandas()
    s = np.sort(x)
    assert (got.below.to_numpy() == np.searchsorted(s, got.v)).all() and (got.n == 3000).all()


def test_shares_follow_columns(spark):
    df = spark.createDataFrame([("a", 1.0, True, "SNWD"), ("a", 2.0, False, "WESD"), ("a", None, True, "WESD")],
                               "ID string, MAX double, PRIORITIZED boolean, ELEMENT string")
    assert fitting.fit_dist(df, "ID", "MAX", "exp").first().PRIORITIZED == 1.0
    assert fitting.fit_dist(df.drop("PRIORITIZED"), "ID", "MAX", "exp").first().PRIORITIZED == 1.0
    assert "PRIORITIZED" not in fitting.fit_dist(df.select("ID", "MAX"), "ID", "MAX", "exp").columns


def test_normal_quantile(spark):
    import statistics
    ps = [1e-12, 1e-4, 0.01, 0.3, 0.5, 0.9, 0.98, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.z for r in extremes.with_qnorm(df, F.col("p"), "z").collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-12)


def test_gev_functions(spark):
    df = spark.createDataFrame([(p, s) for p in (0.01, 0.5, 0.98) for s in (-0.3, 0.0, 1e-10, 0.3)], "p double, s double")
    q = extremes.qgev(F.col("p"), 2.0, 3.0, F.col("s"))
    back = df.withColumn("b", extremes.pgev(q, 2.0, 3.0, F.col("s"))).collect()
    assert all(r.b == pytest.approx(r.p) for r in back)
    edge = spark.createDataFrame([(-1e9, 0.2), (1e9, -0.2), (None, 0.2)], "x double, s double")
    assert [r[0] for r in edge.select(extremes.pgev(F.col("x"), 0.0, 1.0, F.col("s"))).collect()] == [0.0, 1.0, None]
    low = spark.createDataFrame([(-1.0,), (0.0,), (None,)], "p double").select(extremes.qgev(F.col("p"))).collect()
    assert low[0][0] == low[1][0] == pytest.approx(-math.log(-math.log(1e-6))) and low[2][0] is None


def test_gamma_helpers():
    assert numerics.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert numerics.trigamma(1.0) == pytest.approx(math.pi ** 2 / 6)
    a = np.array([0.3, 2.0, 50.0, 4000.0])
    q = numerics.gamma_quantile(np.array([0.1, 0.98, 0.5, 0.999]), a, 2.0)
    assert numerics.gamma_cdf(a, 2 * q) == pytest.approx([0.1, 0.98, 0.5, 0.999])
    assert np.isnan(numerics.gamma_quantile(0.5, np.nan, 1.0))


def test_load_levels(spark, maxima):
    r = {x.ID: x for x in fitting.mle_levels(maxima, "ID", "MAX", {**fitting.LOAD_COLUMNS, "N": ("norm", 0.98)}).collect()}
    assert r["zeros"].DLL == 0 and r["one"].DLG == 3.0 and r["constant"].DLW is None
    assert r["weibull"].DLW == pytest.approx(5 * (-math.log(0.02)) ** (1 / 1.7), rel=0.06)
    assert r["gumbel"].DLI == pytest.approx(10 - 3 * math.log(-math.log(0.98)), rel=0.05)
    few = fitting.mle_levels(maxima, "ID", "MAX", {"W": ("weibull", 0.98), "R": ("revweibull", 0.98)}, small_group=50)
    for x in few.where("ID in ('gamma', 'weibull')").collect():
        assert (x.W, x.R) == (pytest.approx(r[x.ID].DLW, rel=1e-8), pytest.approx(r[x.ID].DLIII, rel=1e-8))
    with pytest.raises(ValueError):
        fitting.mle_levels(maxima, "ID", "MAX", {"x": ("cauchy", 0.98)})


def test_zero_share_shifts_the_level(spark):
    x = [0.0] * 50 + list(np.exp(rng.normal(1, 0.3, 50)))
    r = fitting.fit_dist(spark.createDataFrame([("a", float(v)) for v in x], "ID string, MAX double"), "ID", "MAX", "lnorm").first()
    import statistics
    z = statistics.NormalDist().inv_cdf((0.98 - 0.5) / 0.5)
    assert r.EVENT50 == pytest.approx(math.exp(r.PAR1 + r.PAR2 * z))


def test_snow_classes():
    rows = {r[0]: r[1:] for r in loads.snow_class_rows()}
    assert len(rows) == 6 and rows["Ephemeral"][0] == pytest.approx((0.5975 + 0.5979 + 0.594) / 3)


def test_row_median_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 2.0), (None, None, None), (3.0, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(reshape.row_median("a", "b", "c")).collect()] == [3.0, 2.0, None, 2.0]


def test_one_far_value_does_not_fill_a_bin(spark):
    x = np.append(np.round(rng.gamma(2, 5, 4000), 3), 1e9)
    df = spark.createDataFrame([("a", float(v)) for v in x], "ID string, v0 double")
    counts = fitting.value_counts(df, ["ID"], "v0")
    got = fitting.ranked_counts(counts, ["ID"]).orderBy("v").toPandas()
    s = np.sort(x)
    assert (got.below.to_numpy() == np.searchsorted(s, got.v)).all() and (got.n == 4001).all()


def test_gev_sums_against_numpy(spark):
    x = SAMPLES["gev"][:500]
    for t in ((10.5, 1.2, 0.1), (10.0, 1.0, -0.05), (10.2, 1.1, 1e-6)):
        rows = spark.createDataFrame([(float(v), 2, *t) for v in x], "v double, c int, t0 double, t1 double, t2 double")
        parts = fitting._with_gev_parts(rows)
        got = np.array(parts.agg(F.array(*fitting._gev_derivatives(parts))).first()[0])
        z = (x - t[0]) * np.exp(-t[1])
        grad, hess = numerics.gev_derivatives(z, np.full_like(z, t[2]), np.full_like(z, np.exp(-t[1])))
        assert got == pytest.approx([2 * e.sum() for e in grad + hess], rel=1e-9, abs=1e-7)
        h = 1e-5
        cost = lambda a: rows.agg(F.sum(F.col("c") * fitting._gev_cost(*[F.lit(float(k)) for k in a]))).first()[0]
        for i in range(3):
            up, down = np.array(t), np.array(t)
            up[i], down[i] = up[i] + h, down[i] - h
            assert (cost(up) - cost(down)) / (2 * h) == pytest.approx(got[i], rel=1e-4, abs=1e-3)


def test_one_unsettled_group_leaves_the_others(spark):
    # Two values only: the likelihood grows without bound.
    rows = [("gev", float(v)) for v in SAMPLES["gev"][:300]] + [("two", 1.0), ("two", 2.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "ID string, MAX double")
    alone = fit(df.where("ID = 'gev'"), "gev")["gev"]
    both = fit(df, "gev", small_group=1)
    assert both["two"].PAR1 is None and both["gev"].PAR1 == pytest.approx(alone.PAR1, rel=1e-6)


def test_two_shapes_in_a_group_are_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.2), ("a", 4.0, 0.2)], "ID string, MAX double, SHAPE double")
    with pytest.raises(Exception, match="two shapes"):
        fitting.fit_dist(df, "ID", "MAX", "gev", shape="SHAPE").collect()


def test_fixed_shape_starts_inside_the_support(spark):
    rows = [("a", float(v), -0.4) for v in np.append(SAMPLES["gumbel"][:200], 80.0)]
    df = spark.createDataFrame(rows, "ID string, MAX double, SHAPE double")
    small, large = (fitting.fit_dist(df, "ID", "MAX", "gev", shape="SHAPE", small_group=g).first() for g in (4096, 10))
    assert small.PAR1 is not None and (small.PAR1, small.PAR2) == pytest.approx((large.PAR1, large.PAR2), rel=1e-5)
