"""Distribution fits per group and the return levels they imply.

How the plans scale. Closed forms are one hash aggregate. Rank-based fits
(L-moments, regression) rank within bins of a group's range, so a huge group
is ranked in pieces. Iterative fits first reduce a group to its distinct
values with counts; groups with few distinct values (a station's yearly
maxima) are then solved in batches of groups inside a pandas UDF, and groups
with many are solved by Newton steps whose sums Spark aggregates in parallel.
No group is ever collected whole unless it has at most ``SMALL_GROUP``
distinct values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.functions import extremes, numerics
from firnline.session import cut_lineage

SMALL_GROUP = 4096
#: Pieces of about equally many distinct values that a group is ranked in.
RANK_BINS = 64
_DOUBLE = T.DoubleType()
NEWTON_ROUNDS = 40

METHODS = {
    "lnorm": ("mle", "mme", "regression"),
    "exp": ("mle", "mme"),
    "gamma": ("mle", "mme"),
    "gumbel": ("mle",),
    "gev": ("mle", "lmoments"),
}


# --- ranks and L-moments ----------------------------------------------------

def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct non-null values per group with their counts ``c``, as column ``v``."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("c")))


def ranked_counts(counts: DataFrame, keys) -> DataFrame:
    """Add ``below`` (rows of the group with a smaller value) and ``n`` (rows)."""
    keys = list(keys)
    cuts = [i / RANK_BINS for i in range(1, RANK_BINS)]
    span = counts.groupBy(*keys).agg(F.percentile_approx("v", cuts, 1000).alias("_cuts"), F.sum("c").alias("n"))
    # Any cuts give the same ranks; quantiles keep one far value from filling a single bin with the rest.
    binned = counts.join(span, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda x: x < F.col("v")))).drop("_cuts")
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("c").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(*keys, "_bin", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy(*keys, "_bin").orderBy("v")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (binned.join(starts, [*keys, "_bin"])
            .withColumn("below", F.col("_start") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
            .select(*keys, "v", "c", "below", "n"))


def l_moments(df: DataFrame, keys, value: str) -> DataFrame:
    """Sample L-moments l1, l2 and the ratio t3 per group, zeros left out."""
    counts = value_counts(df.where(F.col(value) != 0), keys, value)
    r = ranked_counts(counts, keys)
    a, c, n = (F.col(k).cast("double") for k in ("below", "c", "n"))
    first = c * a + c * (c - 1) / 2
    second = c * a * a + a * c * (c - 1) + (c - 1) * c * (2 * c - 1) / 6 - first
    pwm = r.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("v") * c / n).alias("b0"),
        F.sum(F.try_divide(F.col("v") * first, n * (n - 1))).alias("b1"),
        F.sum(F.try_divide(F.col("v") * second, n * (n - 1) * (n - 2))).alias("b2"))
    l2 = 2 * F.col("b1") - F.col("b0")
    l3 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    return pwm.select(*keys, "n", F.col("b0").alias("l1"), l2.alias("l2"),
                      F.try_divide(l3, l2).alias("t3"))


def gev_from_l_moments(lm: DataFrame, keys) -> DataFrame:
    """Closed-form GEV estimate: PAR1 location, PAR2 scale, PAR3 shape."""
    z = 2 / (3 + F.col("t3")) - float(np.log(2) / np.log(3))
    k = F.col("_k")
    g = extremes.gamma_function(1 + k)
    scale = F.try_divide(F.col("l2") * k, (1 - F.pow(F.lit(2.0), -k)) * g)
    out = (lm.where((F.col("n") >= 3) & (F.col("l2") > 0))
           .withColumn("_k", 7.8590 * z + 2.9554 * z * z)
           .where(F.col("_k") > -1)
           .withColumn("PAR2", scale)
           .withColumn("PAR1", F.col("l1") - F.try_divide(F.col("PAR2") * (1 - g), k))
           .withColumn("PAR3", -k))
    return out.select(*keys, "PAR1", "PAR2", "PAR3")


def plotting_positions(df: DataFrame, keys, value: str) -> DataFrame:
    """Each value with its rank ``i`` in its group and ``p = i / (n + 1)``."""
    r = ranked_counts(value_counts(df, keys, value), keys)
    each = r.select(*keys, "v", "n",
                    F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("c"))).alias("i"))
    return each.withColumn("p", F.col("i") / (F.col("n") + 1))


def lnorm_regression(df: DataFrame, keys, value: str, tail: float = 1) -> DataFrame:
    """Normal quantiles of the plotting positions regressed on the log values.

    Zeros take part in the ranks and not in the regression. Only the upper
    ``tail`` share of the ranks is used.
    """
    pos = plotting_positions(df, keys, value)
    used = pos.where((F.col("v") > 0) & (F.col("i") > (1 - float(tail)) * F.col("n")) & (F.col("n") > 1))
    scored = extremes.with_qnorm(used.withColumn("_x", F.ln("v")), F.col("p"), "_q")
    fit = scored.groupBy(*keys).agg(
        F.regr_slope("_q", "_x").alias("_b1"), F.regr_intercept("_q", "_x").alias("_b0"))
    return fit.select(*keys, F.try_divide(-F.col("_b0"), F.col("_b1")).alias("PAR1"),
                      F.try_divide(F.lit(1.0), F.col("_b1")).alias("PAR2"))


# --- likelihood fits ----------------------------------------------------------

def split_by_size(counts: DataFrame, keys, small_group: int = SMALL_GROUP):
    """Groups with few and with many distinct values; the second is None if empty."""
    counts = cut_lineage(counts)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > small_group)
    if not sizes.take(1):
        return counts, None
    large = sizes.select(*keys)
    return counts.join(large, keys, "left_anti"), counts.join(large, keys, "left_semi")


def _as_arrays(counts: DataFrame, keys) -> DataFrame:
    return (counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("_vc"))
            .select(*keys, F.col("_vc.v").alias("_v"), F.col("_vc.c").alias("_c")))


@F.pandas_udf(T.StructType([T.StructField("k", _DOUBLE), T.StructField("log_scale", _DOUBLE)]))
def _tilt_udf(v: pd.Series, c: pd.Series) -> pd.DataFrame:
    k, scale = numerics.tilt(v.to_list(), c.to_list())
    return pd.DataFrame({"k": k, "log_scale": scale})


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def tilt_fit(counts: DataFrame, keys, small_group: int = SMALL_GROUP) -> DataFrame:
    """Solve the tilt equation (see ``numerics.tilt``) per group of (v, c) rows."""
    keys = list(keys)
    small, large = split_by_size(counts, keys, small_group)
    solved = (_as_arrays(small, keys).withColumn("_t", _tilt_udf("_v", "_c"))
              .select(*keys, _nan_to_null(F.col("_t.k")).alias("k"),
                      _nan_to_null(F.col("_t.log_scale")).alias("log_scale")))
    return solved if large is None else solved.unionByName(_tilt_by_passes(large, keys))


def _tilt_by_passes(counts: DataFrame, keys) -> DataFrame:
    """The same equation with every Newton step one parallel aggregate."""
    base = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.max("v").alias("top"),
        (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"),
        F.sum(F.col("c") * F.col("v") * F.col("v")).alias("_sq"))
    var = F.greatest(F.col("_sq") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(1e-300))
    state = cut_lineage(base.select(*keys, "n", "top", "mean",
                                    (1.2825498301618641 / F.sqrt(var)).alias("k"),
                                    F.lit(1.0).alias("move")))
    shifted = F.col("v") - F.col("top")
    weight = F.col("c") * F.exp(F.col("k") * shifted)
    for _ in range(NEWTON_ROUNDS):
        sums = counts.join(state, keys).groupBy(*keys, "n", "top", "mean", "k").agg(
            F.sum(weight).alias("s0"), F.sum(weight * shifted).alias("s1"),
            F.sum(weight * shifted * shifted).alias("s2"))
        tilted = F.col("s1") / F.col("s0")
        gap = tilted - (F.col("mean") - F.col("top")) - 1 / F.col("k")
        slope = F.col("s2") / F.col("s0") - tilted * tilted + 1 / (F.col("k") * F.col("k"))
        new = F.greatest(F.least(F.col("k") - gap / slope, F.col("k") * 4), F.col("k") / 4)
        state = cut_lineage(sums.select(
            *keys, "n", "top", "mean", new.alias("k"),
            F.abs(new / F.col("k") - 1).alias("move")))
        if state.agg(F.max("move")).first()[0] < 1e-12:
            break
    sums = counts.join(state, keys).groupBy(*keys, "n", "top", "k").agg(F.sum(weight).alias("s0"))
    return sums.select(*keys, "k", (F.col("top") + F.ln(F.col("s0") / F.col("n")) / F.col("k")).alias("log_scale"))


_GEV_TYPE = T.StructType([T.StructField(f"p{i}", _DOUBLE) for i in (1, 2, 3)])


@F.pandas_udf(_GEV_TYPE)
def _gev_udf(v: pd.Series, c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(numerics.gev_fit(v.to_list(), c.to_list()), columns=["p1", "p2", "p3"])


@F.pandas_udf(_GEV_TYPE)
def _gev_shape_udf(v: pd.Series, c: pd.Series, shape: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(numerics.gev_fit(v.to_list(), c.to_list(), shape.to_numpy(dtype=float)),
                        columns=["p1", "p2", "p3"])


def gev_mle(counts: DataFrame, keys, shapes: DataFrame | None = None,
            small_group: int = SMALL_GROUP) -> DataFrame:
    """GEV maximum likelihood per group; ``shapes`` (keys, shape) holds fixed shapes."""
    keys = list(keys)
    small, large = split_by_size(counts, keys, small_group)
    arrays = _as_arrays(small, keys)
    if shapes is None:
        solved = arrays.withColumn("_t", _gev_udf("_v", "_c"))
    else:
        shapes = shapes.where(F.col("shape").isNotNull())
        solved = arrays.join(shapes, keys).withColumn("_t", _gev_shape_udf("_v", "_c", "shape"))
    solved = solved.select(*keys, *[_nan_to_null(F.col(f"_t.p{i}")).alias(f"PAR{i}") for i in (1, 2, 3)])
    return solved if large is None else solved.unionByName(_gev_by_passes(large, keys, shapes))


def _series(p: Column, *terms: float) -> Column:
    """terms[0] + terms[1] p + terms[2] p^2 + ..."""
    out = F.lit(float(terms[-1]))
    for t in reversed(terms[:-1]):
        out = out * p + F.lit(float(t))
    return out


def _gev_cost(loc: Column, log_scale: Column, shape: Column) -> Column:
    """Negative log likelihood of one value; huge outside the support."""
    z = (F.col("v") - loc) * F.exp(-log_scale)
    p = shape * z
    u = F.when(F.abs(p) < numerics.SERIES, z * _series(p, 1, -1 / 2, 1 / 3, -1 / 4, 1 / 5)).otherwise(
        F.try_divide(F.ln(1 + p), shape))
    return F.when(p > -1, log_scale + (1 + shape) * u + F.exp(F.least(-u, F.lit(700.0)))).otherwise(F.lit(1e12))


def _gev_derivatives(rows: DataFrame) -> list[Column]:
    """Sums over ``rows(v, c, t0, t1, t2)`` of the 3 first and 6 second derivatives; see ``numerics.gev_derivatives``."""
    z, xi, y, p, c = (F.col(k) for k in ("_z", "t2", "_y", "_p", "c"))
    u, u1, u2, t, s = (F.col(k) for k in ("_u", "_u1", "_u2", "_t", "_s"))
    rest = 1 + xi - t
    a, a_z, a_xi = rest / y, (1 + xi) * (t - xi) / (y * y), (1 + t * u1) / y - rest * z / (y * y)
    each = [-s * a, 1 - z * a, u + rest * u1,
            s * s * a_z, s * (a + z * a_z), -s * a_xi, z * (a + z * a_z), -z * a_xi, 2 * u1 + rest * u2 + t * u1 * u1]
    return [F.sum(c * e) for e in each]


def _with_gev_parts(rows: DataFrame) -> DataFrame:
    xi, z, y, p, u, u1 = (F.col(k) for k in ("t2", "_z", "_y", "_p", "_u", "_u1"))
    small = F.abs(p) < numerics.SERIES
    rows = rows.withColumn("_s", F.exp(-F.col("t1"))).withColumn("_z", (F.col("v") - F.col("t0")) * F.col("_s"))
    rows = rows.withColumn("_p", xi * z).withColumn("_y", 1 + p)
    rows = rows.withColumn("_u", F.when(small, z * _series(p, 1, -1 / 2, 1 / 3, -1 / 4, 1 / 5)).otherwise(F.try_divide(F.ln(y), xi)))
    rows = rows.withColumn("_u1", F.when(small, z * z * _series(p, -1 / 2, 2 / 3, -3 / 4, 4 / 5, -5 / 6)).otherwise(
        F.try_divide(F.try_divide(z, y) - u, xi)))
    rows = rows.withColumn("_u2", F.when(small, z * z * z * _series(p, 2 / 3, -6 / 4, 12 / 5, -20 / 6, 30 / 7)).otherwise(
        F.try_divide(-F.pow(F.try_divide(z, y), F.lit(2.0)) - 2 * u1, xi)))
    return rows.withColumn("_t", F.exp(F.least(-u, F.lit(700.0))))


def _gev_by_passes(counts: DataFrame, keys, shapes: DataFrame | None = None) -> DataFrame:
    """The Newton steps of ``numerics.gev_fit`` with every sum a parallel aggregate.

    One pass sums gradient and Hessian, the next the cost at a ladder of step
    lengths; only sums per group leave the tasks. Each group stops by itself
    and takes no part in later passes; one that has not settled by the last
    round has null parameters.
    """
    free = 3 if shapes is None else 2
    ladder = numerics.LADDER
    base = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"),
                                     F.sum(F.col("c") * F.col("v")).alias("_s"),
                                     F.sum(F.col("c") * F.col("v") * F.col("v")).alias("_q"))
    mean = F.col("_s") / F.col("n")
    scale = F.sqrt(6 * F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(1e-300))) / float(np.pi)
    start = base.select(*keys, "n", "_lo", "_hi", (mean - numerics.EULER * scale).alias("t0"), F.ln(scale).alias("t1"), F.lit(0.01).alias("t2"))
    if shapes is not None:
        start = start.drop("t2").join(shapes.withColumnRenamed("shape", "t2"), keys)
    need = F.greatest(*[-F.col("t2") * (F.col(k) - F.col("t0")) for k in ("_lo", "_hi")])
    steps = F.floor((F.ln(need) - F.col("t1")) / numerics.WIDEN) + 1
    wide = F.when(need > 0, numerics.WIDEN * F.greatest(steps, F.lit(0))).otherwise(F.lit(0.0))
    state = cut_lineage(start.select(*keys, "n", "t0", (F.col("t1") + wide).alias("t1"), F.col("t2").cast("double").alias("t2"),
                                     F.lit(float("inf")).alias("decrement"), F.lit(False).alias("done")))

    @F.pandas_udf(T.ArrayType(_DOUBLE))
    def direction(sums: pd.Series, scales: pd.Series) -> pd.Series:
        both = np.array(sums.to_list(), dtype=float)
        widths = np.ones((len(both), free))
        widths[:, 0] = scales
        step, decrement = numerics.newton_step(both[:, :free], numerics.full_hessian(both[:, 3:], free), widths)
        return pd.Series(np.column_stack([step, decrement]).tolist())

    theta = [F.col("t0"), F.col("t1"), F.col("t2")]
    for _ in range(numerics.ROUNDS):
        moving = state.where("not done")
        rows = _with_gev_parts(counts.join(moving, keys))
        local = rows.groupBy(*keys, "n", "t0", "t1", "t2").agg(F.array(*_gev_derivatives(rows)).alias("f"))
        local = local.withColumn("f", F.transform("f", lambda x: x / F.col("n")))
        aimed = cut_lineage(local.withColumn("d", direction("f", F.exp("t1"))).drop("f"))
        step = [F.col("d")[i] if i < free else F.lit(0.0) for i in range(3)]
        trial = counts.join(aimed, keys).groupBy(*keys, "n", "t0", "t1", "t2", "d").agg(
            F.array(*[F.sum(F.col("c") * _gev_cost(*[t + s * a for t, s in zip(theta, step)])) for a in ladder]).alias("g"))
        best = F.element_at(F.array(*[F.lit(a) for a in ladder]), F.array_position("g", F.array_min("g")).cast("int"))
        moved = trial.withColumn("a", best).select(
            *keys, "n", *[(t + s * F.col("a")).alias(f"t{i}") for i, (t, s) in enumerate(zip(theta, step))],
            F.element_at("d", -1).alias("decrement"), "a")
        stop = (F.col("decrement") < numerics.STOP) | (F.col("a") == 0) | (F.col("t2") < -1)
        state = cut_lineage(state.where("done").unionByName(moved.withColumn("done", stop).drop("a")))
        if not state.where("not done").take(1):
            break
    good = (F.col("decrement") < numerics.SETTLED) & (F.col("t2") > -1)
    return state.select(*keys, *[F.when(good, c).alias(f"PAR{i}") for i, c in enumerate(
        [F.col("t0"), F.exp("t1"), F.col("t2")], 1)])


@F.pandas_udf(_DOUBLE)
def _gamma_shape_udf(gap: pd.Series) -> pd.Series:
    return pd.Series(numerics.gamma_shape(gap.to_numpy(dtype=float)))


@F.pandas_udf(_DOUBLE)
def qgamma(p: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.Series:
    """Gamma quantile, one Arrow batch at a time."""
    return pd.Series(numerics.gamma_quantile(*(s.to_numpy(dtype=float) for s in (p, shape, rate))))


# --- the fit table ------------------------------------------------------------

def with_quantile(df: DataFrame, distr: str, p: Column, out: str) -> DataFrame:
    """Add the ``p`` quantile of the distribution with parameters PAR1..PAR3."""
    par1, par2, par3 = F.col("PAR1"), F.col("PAR2"), F.col("PAR3")
    if distr == "lnorm":
        return extremes.with_qnorm(df, p, "_z").withColumn(out, F.exp(par1 + par2 * F.col("_z"))).drop("_z")
    df = df.withColumn("_p", p)
    if distr == "exp":
        level = extremes.qexp(F.col("_p"), par1)
    elif distr == "gamma":
        level = _nan_to_null(qgamma("_p", par1, par2))
    elif distr == "gumbel":
        level = extremes.qgumbel(F.col("_p"), par1, par2)
    elif distr == "gev":
        level = extremes.qgev_exact(F.col("_p"), par1, par2, par3)
    else:
        raise ValueError(f"no distribution {distr!r}")
    return df.withColumn(out, level).drop("_p")


def with_event_level(fits: DataFrame, distr: str, share: float = 0.98, out: str = "EVENT50") -> DataFrame:
    """Add the level exceeded in a share ``1 - share`` of years, given PROP_ZERO, the share of zero years."""
    zero = F.col("PROP_ZERO")
    p = F.when(zero < share, (F.lit(share) - zero) / (1 - zero))
    return with_quantile(fits, distr, p, "_level").withColumn(
        out, F.when(zero >= share, F.lit(0.0)).when(F.col("PAR1").isNotNull(), F.col("_level"))).drop("_level")


def fit_dist(df: DataFrame, id: str, values: str, distr: str, method: str = "mle",
             tail: float = 1, shape: str | None = None, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row per id: DISTR, NFIT, PROP_ZERO, [PRIORITIZED], PAR1..PAR3, EVENT50.

    Zeros and nulls take no part in the fit (in the ``regression`` method zeros
    do, through the ranks). One value or a failing fit gives null parameters.
    A boolean PRIORITIZED column is summarised as its share; without one, an
    ELEMENT column gives the share of WESD rows.
    """
    if distr not in METHODS or method not in METHODS[distr]:
        raise ValueError(f"no method {method!r} for distribution {distr!r}")
    if shape is not None and (distr, method) != ("gev", "mle"):
        raise ValueError("shape is for the gev likelihood only")

    v = F.col(values).cast("double")
    x = F.when(v != 0, v)
    logx = F.when(x > 0, F.ln(x))
    aggs = [F.count(v).alias("NFIT"),
            F.sum(F.when(v == 0, 1).otherwise(0)).alias("_zeros"),
            F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"),
            F.min(x).alias("_lo"), F.max(x).alias("_hi"),
            F.avg(logx).alias("_ml"), F.stddev_pop(logx).alias("_sl")]
    if "PRIORITIZED" in df.columns:
        aggs.append(F.sum(F.col("PRIORITIZED").cast("int")).alias("_prior"))
    elif "ELEMENT" in df.columns:
        aggs.append(F.sum(F.when(F.col("ELEMENT") == "WESD", 1).otherwise(0)).alias("_prior"))
    table = df.groupBy(id).agg(*aggs)

    none = F.lit(None).cast("double")
    n, m, var = F.col("_n"), F.col("_m"), F.col("_v")
    positive, varied = F.col("_lo") > 0, F.col("_hi") > F.col("_lo")

    def closed(ok, *pars):
        pars = list(pars) + [none] * (3 - len(pars))
        return table.withColumns({f"PAR{i + 1}": F.when((n > 1) & ok, p) for i, p in enumerate(pars)})

    def joined(fit):
        fit = fit.withColumnRenamed(id, "_id")
        for i in (1, 2, 3):
            if f"PAR{i}" not in fit.columns:
                fit = fit.withColumn(f"PAR{i}", none)
        return table.join(fit, F.col(id).eqNullSafe(F.col("_id")), "left").drop("_id")

    nonzero = df.where(v != 0)
    if (distr, method) == ("lnorm", "mle"):
        out = closed(positive & varied, F.col("_ml"), F.col("_sl"))
    elif (distr, method) == ("lnorm", "mme"):
        spread = F.ln(1 + F.try_divide(var, m * m))
        out = closed(positive, F.ln(m) - spread / 2, F.sqrt(spread))
    elif (distr, method) == ("lnorm", "regression"):
        out = joined(lnorm_regression(df, [id], values, tail))
    elif distr == "exp":
        out = closed(positive, F.try_divide(F.lit(1.0), m))
    elif (distr, method) == ("gamma", "mme"):
        out = closed(positive & varied, F.try_divide(m * m, var), F.try_divide(m, var))
    elif (distr, method) == ("gamma", "mle"):
        k = _nan_to_null(_gamma_shape_udf(F.ln("_m") - F.col("_ml")))
        out = (table.withColumn("PAR1", F.when((n > 1) & positive & varied, k))
               .withColumn("PAR2", F.col("PAR1") / m).withColumn("PAR3", none))
    elif distr == "gumbel":
        flipped = value_counts(nonzero, [id], values).withColumn("v", -F.col("v"))
        t = tilt_fit(flipped, [id], small_group)
        out = joined(t.select(id, (-F.col("log_scale")).alias("PAR1"), (1 / F.col("k")).alias("PAR2")))
    elif method == "lmoments":
        out = joined(gev_from_l_moments(l_moments(df, [id], values), [id]))
    else:
        shapes = None if shape is None else _one_shape(df, id, F.col(shape).cast("double"))
        out = joined(gev_mle(value_counts(nonzero, [id], values), [id], shapes, small_group))

    out = out.withColumns({"DISTR": F.lit(distr),
                           "PROP_ZERO": F.try_divide(F.col("_zeros"), F.col("NFIT"))})
    extra = []
    if "_prior" in out.columns:
        out = out.withColumn("PRIORITIZED", F.try_divide(F.col("_prior"), F.col("NFIT")))
        extra = ["PRIORITIZED"]
    return with_event_level(out, distr).select(
        id, "DISTR", "NFIT", "PROP_ZERO", *extra, "PAR1", "PAR2", "PAR3", "EVENT50")


def _one_shape(df: DataFrame, id: str, shape: Column) -> DataFrame:
    """The fixed shape of each group. Rows have no order that could make one the first, so two shapes are an error."""
    found = df.groupBy(id).agg(F.min(shape).alias("shape"), F.max(shape).alias("_other"))
    return found.select(id, F.when(F.col("shape") < F.col("_other"), F.raise_error(F.lit("a group has two shapes")).cast("double"))
                        .otherwise(F.col("shape")).alias("shape"))


def return_levels(fits: DataFrame, id: str, periods, tol: float = 1e-6) -> DataFrame:
    """GEV return levels of every fit (PAR1..PAR3) for each return period in years."""
    each = fits.withColumn("PERIOD", F.explode(F.array(*[F.lit(float(p)) for p in periods])))
    level = extremes.qgev(1 - 1 / F.col("PERIOD"), F.col("PAR1"), F.col("PAR2"),
                          F.coalesce("PAR3", F.lit(0.0)), tol)
    return each.select(id, "PERIOD", level.alias("LEVEL"))


def exceedance(df: DataFrame, fits: DataFrame, id: str, value: str, out: str = "P_EXCEED") -> DataFrame:
    """Probability that a year exceeds each value, from its id's GEV fit."""
    p = fits.select(F.col(id).alias("_id"), "PAR1", "PAR2", "PAR3")
    both = df.join(p, F.col(id).eqNullSafe(F.col("_id")), "left")
    below = extremes.pgev(F.col(value), F.col("PAR1"), F.col("PAR2"), F.coalesce("PAR3", F.lit(0.0)))
    return both.withColumn(out, 1 - below).select(*df.columns, out)


# --- load percentiles ----------------------------------------------------------

WEIBULL_FAMILY = ("weibull", "frechet", "gumbel", "revweibull")
LOAD_DISTRIBUTIONS = ("lnorm", "norm", "gamma") + WEIBULL_FAMILY
MIN_POSITIVE = 5


def mle_levels(df: DataFrame, id: str, value: str, requests, small_group: int = SMALL_GROUP) -> DataFrame:
    """Upper percentiles per id; ``requests`` maps output name to (distribution, share).

    No positive value gives 0, fewer than five give the maximum, equal values
    have no fit and give null, and a share inside the zeros gives 0.
    """
    wanted = {d for d, _ in requests.values()}
    if wanted - set(LOAD_DISTRIBUTIONS):
        raise ValueError(f"no distributions {sorted(wanted - set(LOAD_DISTRIBUTIONS))}")
    v = F.col(value).cast("double")
    x = F.when(v > 0, v)
    table = df.groupBy(id).agg(
        F.count(v).alias("_n"), F.count(x).alias("_pos"), F.max(v).alias("_top"),
        F.min(x).alias("_lo"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"),
        F.avg(F.ln(x)).alias("_ml"), F.stddev_pop(F.ln(x)).alias("_sl"))
    varied = F.col("_top") > F.col("_lo")

    family = [d for d in WEIBULL_FAMILY if d in wanted]
    if family:
        spread = table.select(F.col(id).alias("_id"), F.col("_m").alias("_mean"), F.col("_top").alias("_max"))
        counts = value_counts(df.where(v > 0), [id], value).join(
            spread, F.col(id).eqNullSafe(F.col("_id"))).drop("_id")
        forms = {"weibull": F.ln("v"), "frechet": -F.ln("v"), "gumbel": F.col("_mean") - F.col("v"),
                 "revweibull": F.ln(F.col("_max") + 1 - F.col("v"))}
        long = counts.select(id, "c", F.explode(F.create_map(
            *[e for d in family for e in (F.lit(d), forms[d])])).alias("family", "v"))
        t = tilt_fit(long, [id, "family"], small_group)
        wide = t.groupBy(F.col(id).alias("_id")).agg(
            *[F.max(F.when(F.col("family") == d, F.struct("k", "log_scale"))).alias(f"_{d}") for d in family])
        table = table.join(wide, F.col(id).eqNullSafe(F.col("_id")), "left").drop("_id")
    if "gamma" in wanted:
        table = table.withColumn("_k", F.when(varied, _nan_to_null(_gamma_shape_udf(F.ln("_m") - F.col("_ml")))))

    table = table.withColumn("_zero", 1 - F.try_divide(F.col("_pos"), F.col("_n")))
    place = {share: i for i, share in enumerate(sorted({s for _, s in requests.values()}))}
    for share, i in place.items():
        table = table.withColumn(f"_t{i}", F.try_divide(F.lit(share) - F.col("_zero"), 1 - F.col("_zero")))
        inside = F.when((F.col(f"_t{i}") > 0) & (F.col(f"_t{i}") < 1), F.col(f"_t{i}"))
        table = table.withColumn(f"_in{i}", inside)
        if wanted & {"lnorm", "norm"}:
            table = extremes.with_qnorm(table, F.col(f"_in{i}"), f"_z{i}")

    def level(distr, share):
        t, p, z = (F.col(f"_{c}{place[share]}") for c in ("t", "in", "z"))
        if distr == "lnorm":
            fit = F.when(varied, F.exp(F.col("_ml") + F.col("_sl") * z))
        elif distr == "norm":
            fit = F.when(varied, F.col("_m") + F.col("_s") * z)
        elif distr == "gamma":
            fit = _nan_to_null(qgamma(p, F.col("_k"), F.col("_k") / F.col("_m")))
        else:
            k, ls = F.col(f"_{distr}.k"), F.col(f"_{distr}.log_scale")
            if distr == "weibull":
                fit = F.exp(ls + F.ln(-F.ln(1 - p)) / k)
            elif distr == "frechet":
                fit = F.exp(-ls - F.ln(-F.ln(p)) / k)
            elif distr == "gumbel":
                fit = F.col("_m") - ls - F.ln(-F.ln(p)) / k
            else:
                fit = F.col("_top") + 1 - F.exp(ls + F.ln(-F.ln(p)) / k)
        return (F.when(F.col("_top") == 0, 0.0)
                .when(F.col("_pos") < MIN_POSITIVE, F.col("_top"))
                .when(varied & (t <= 0), 0.0).otherwise(fit))

    return table.select(id, *[level(d, s).alias(name) for name, (d, s) in requests.items()])


# The load columns, their distributions and shares.
LOAD_COLUMNS = {
    "DLL": ("lnorm", 0.98), "DLL2": ("lnorm", 0.99),
    "DLG": ("gamma", 0.98), "DLG2": ("gamma", 0.99),
    "DLI": ("gumbel", 0.98), "DLI2": ("gumbel", 0.99),
    "DLII": ("frechet", 0.98), "DLII2": ("frechet", 0.99),
    "DLIII": ("revweibull", 0.98), "DLIII2": ("revweibull", 0.99),
    "DLW": ("weibull", 0.98), "DLW2": ("weibull", 0.99),
}


def load_summary(df: DataFrame, id: str, value: str) -> DataFrame:
    """Median, maximum, number of maxima and all load percentiles per id."""
    basic = df.groupBy(F.col(id).alias("_id")).agg(
        F.median(value).alias("medMax"), F.max(value).alias("mMax"), F.count(F.lit(1)).alias("numMax"))
    levels = mle_levels(df, id, value, LOAD_COLUMNS)
    return levels.join(basic, F.col(id).eqNullSafe(F.col("_id"))).drop("_id")
