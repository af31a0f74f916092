"""Distribution fits, return levels and load percentiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from firnline.functions import extremes, labels
from firnline.operators import fitting, maxima, qc
from firnline.plans import station
from firnline.registry.base import big, query, rnd
from firnline.registry.sqltext import (ROW_RULES, gamma_quantile_sql, gamma_shape_sql, qnorm_sql, tilt_sql,
                                       with_views, wy)

CLEAN_SPARSE = f"SELECT * FROM obs_sparse WHERE {ROW_RULES}"
YM = f"SELECT ID, {wy()} AS YEAR, max(VALUE) AS MAX FROM clean GROUP BY ALL"
SUMMARY = """SELECT ID, count(MAX) AS NFIT, sum(CASE WHEN MAX = 0 THEN 1 ELSE 0 END) / count(MAX) AS Z,
  count(CASE WHEN MAX <> 0 THEN 1 END) AS N, avg(CASE WHEN MAX <> 0 THEN MAX END) AS M,
  var_pop(CASE WHEN MAX <> 0 THEN MAX END) AS V, avg(CASE WHEN MAX > 0 THEN ln(MAX) END) AS ML,
  stddev_pop(CASE WHEN MAX > 0 THEN ln(MAX) END) AS SL,
  min(CASE WHEN MAX <> 0 THEN MAX END) AS LO, max(CASE WHEN MAX <> 0 THEN MAX END) AS HI FROM ym GROUP BY ID"""
FIT_VIEWS = {"clean": CLEAN_SPARSE, "ym": YM, "summ": SUMMARY}
P = "((0.98 - Z) / (1 - Z))"


def sparse_maxima(cat):
    return maxima.yearly_maximums(qc.clean_station_data(cat.obs_sparse), "ID", "DATE", "VALUE")


def fit_sql(pars: str, level: str, source: str = "summ") -> str:
    """Fit table text: ``pars`` makes PAR1.. from ``source`` (ID, NFIT, Z, ...); ``level`` the quantile at P."""
    return f"""SELECT ID, NFIT, round(Z, 6) AS PROP_ZERO, round(PAR1, 5) AS PAR1, round(PAR2, 5) AS PAR2,
      round(CASE WHEN Z >= 0.98 THEN 0 WHEN PAR1 IS NULL THEN NULL ELSE {level} END, 4) AS EVENT50
      FROM (SELECT *, {pars} FROM {source})"""


def fit_rows(df, par3: bool = False):
    pars = ["PAR1", "PAR2"] + (["PAR3"] if par3 else [])
    return df.select("ID", "NFIT", rnd("PROP_ZERO").alias("PROP_ZERO"),
                     *[rnd(p, 5).alias(p) for p in pars], rnd("EVENT50", 4).alias("EVENT50"))


LNORM_LEVEL = f"exp(PAR1 + PAR2 * ({qnorm_sql(P)}))"


@query("d1_lnorm_event50", with_views(fit_sql(
    "CASE WHEN N > 1 AND LO > 0 AND HI > LO THEN ML END AS PAR1, CASE WHEN N > 1 AND LO > 0 AND HI > LO THEN SL END AS PAR2",
    LNORM_LEVEL), "obs_sparse", **FIT_VIEWS))
def d1(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "lnorm"))


@query("d1_lnorm_moments", with_views(fit_sql(
    """CASE WHEN N > 1 AND LO > 0 THEN ln(M) - ln(1 + V / (M * M)) / 2 END AS PAR1,
       CASE WHEN N > 1 AND LO > 0 THEN sqrt(ln(1 + V / (M * M))) END AS PAR2""", LNORM_LEVEL),
    "obs_sparse", **FIT_VIEWS))
def d1_mme(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "lnorm", "mme"))


REGRESSION = f"""SELECT ID, regr_slope(q, x) AS B1, regr_intercept(q, x) AS B0 FROM (
  SELECT ID, ln(MAX) AS x, {qnorm_sql('pp')} AS q FROM (
    SELECT ID, MAX, I, N, I / (N + 1) AS pp FROM (
      SELECT ID, MAX, row_number() OVER (PARTITION BY ID ORDER BY MAX) AS I, count(*) OVER (PARTITION BY ID) AS N FROM ym))
  WHERE MAX > 0 AND N > 1 AND I > (1 - {{tail}}) * N) GROUP BY ID"""


def _regression_sql(tail):
    return with_views(fit_sql("-B0 / nullif(B1, 0) AS PAR1, 1 / nullif(B1, 0) AS PAR2", LNORM_LEVEL,
                              "(SELECT summ.*, B0, B1 FROM summ LEFT JOIN reg USING (ID))"),
                      "obs_sparse", **FIT_VIEWS, reg=REGRESSION.format(tail=tail))


@query("d2_lnorm_regression", _regression_sql(1))
def d2(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "lnorm", "regression"))


@query("d2_lnorm_regression_tail", _regression_sql(0.5))
def d2_tail(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "lnorm", "regression", tail=0.5))


@query("w7_plotting_positions", with_views("""
SELECT ID, MAX, I, round(I / (N + 1), 6) AS P FROM (SELECT ID, MAX,
  row_number() OVER (PARTITION BY ID ORDER BY MAX) AS I, count(*) OVER (PARTITION BY ID) AS N FROM ym)""",
                                           "obs_sparse", clean=CLEAN_SPARSE, ym=YM))
def w7(cat):
    return fitting.plotting_positions(sparse_maxima(cat), ["ID"], "MAX").select(
        "ID", F.col("v").alias("MAX"), big("i").alias("I"), rnd("p").alias("P"))


@query("d3_exponential", with_views(fit_sql(
    "CASE WHEN N > 1 AND LO > 0 THEN 1 / M END AS PAR1, CAST(NULL AS DOUBLE) AS PAR2", f"-ln(1 - {P}) / PAR1"),
    "obs_sparse", **FIT_VIEWS))
def d3(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "exp"))


GAMMA_FIT = """SELECT ID, NFIT, round(Z, 6) AS PROP_ZERO, round(PAR1, 5) AS PAR1, round(PAR2, 5) AS PAR2,
  round(CASE WHEN Z >= 0.98 THEN 0 WHEN PAR1 IS NULL THEN NULL ELSE x / PAR2 END, 3) AS EVENT50
  FROM pars LEFT JOIN gq_fit ON ID = G"""


def _gamma_rows(df):
    return df.select("ID", "NFIT", rnd("PROP_ZERO").alias("PROP_ZERO"), rnd("PAR1", 5).alias("PAR1"),
                     rnd("PAR2", 5).alias("PAR2"), rnd("EVENT50", 3).alias("EVENT50"))


QUANTILE_INPUT = f"SELECT ID AS G, {P} AS p, PAR1 AS a FROM pars WHERE PAR1 IS NOT NULL AND Z < 0.98"


@query("d4_gamma_moments", with_views(
    GAMMA_FIT.replace("round(PAR1, 5) AS PAR1, round(PAR2, 5) AS PAR2",
                      "round(ln(PAR1), 6) AS LOG_PAR1, round(ln(PAR2), 6) AS LOG_PAR2"), "obs_sparse", **FIT_VIEWS,
    pars="""SELECT *, CASE WHEN N > 1 AND HI > LO AND LO > 0 THEN M * M / V END AS PAR1,
            CASE WHEN N > 1 AND HI > LO AND LO > 0 THEN M / V END AS PAR2 FROM summ""",
    qin=QUANTILE_INPUT, **gamma_quantile_sql("qin")))
def d4(cat):
    out = station.station_fits(cat.obs_sparse, "gamma", "mme")
    return out.select("ID", "NFIT", rnd("PROP_ZERO").alias("PROP_ZERO"), rnd(F.ln("PAR1")).alias("LOG_PAR1"),
                      rnd(F.ln("PAR2")).alias("LOG_PAR2"), rnd("EVENT50", 3).alias("EVENT50"))


GAMMA_MLE = {
    "gsrc": "SELECT ID AS G, M AS m, ML AS ml FROM summ WHERE N > 1 AND LO > 0 AND HI > LO",
    **gamma_shape_sql("gsrc"),
    "pars": "SELECT summ.*, k AS PAR1, k / M AS PAR2 FROM summ LEFT JOIN gk15 ON ID = G",
}


@query("d5_gamma_mle", with_views(GAMMA_FIT, "obs_sparse", **FIT_VIEWS, **GAMMA_MLE, qin=QUANTILE_INPUT,
                                  **gamma_quantile_sql("qin")))
def d5(cat):
    return _gamma_rows(station.station_fits(cat.obs_sparse, "gamma"))


@query("d6_gumbel_mle", with_views(fit_sql(
    "-log_scale AS PAR1, 1 / k AS PAR2", f"PAR1 - PAR2 * ln(-ln({P}))",
    "(SELECT summ.*, k, log_scale FROM summ LEFT JOIN tk_fit ON ID = G)"), "obs_sparse", **FIT_VIEWS,
    ysrc="SELECT ID AS G, -MAX AS y FROM ym WHERE MAX <> 0", **tilt_sql("ysrc")))
def d6(cat):
    return fit_rows(station.station_fits(cat.obs_sparse, "gumbel"))


@query("d7_gev_mle")
def d7(cat):
    return fit_rows(station.station_fits(cat.obs, "gev"), par3=True)


@query("d8_gev_fixed_shape")
def d8(cat):
    ym = sparse_maxima(cat).withColumn("SHAPE", F.lit(0.1))
    return fit_rows(fitting.fit_dist(ym, "ID", "MAX", "gev", shape="SHAPE"), par3=True)


def _likelihood(ym, fits, free: int = 3):
    """(ID, flat, cost): whether the likelihood of each fit has no slope in its free parameters, and its negative."""
    known = fits.where(F.col("PAR1").isNotNull()).select(
        F.col("ID").alias("_id"), F.col("PAR1").alias("t0"), F.ln("PAR2").alias("t1"), F.col("PAR3").alias("t2"))
    rows = ym.where(F.col("MAX") != 0).select("ID", F.col("MAX").alias("v"), F.lit(1).alias("c")).join(known, F.col("ID") == F.col("_id"))
    # Slopes by differences of the cost, not by the derivatives that the fit uses; location in units of the scale.
    step = 1e-5
    theta = [F.col("t0"), F.col("t1"), F.col("t2")]

    def moved(i: int, by: float):
        width = F.exp("t1") if i == 0 else F.lit(1.0)
        return F.sum(fitting._gev_cost(*[t + by * width if k == i else t for k, t in enumerate(theta)]))
    slopes = [((moved(i, step) - moved(i, -step)) / (2 * step * F.count(F.lit(1)))).alias(f"s{i}") for i in range(free)]
    out = rows.groupBy("ID").agg(*slopes, F.sum(fitting._gev_cost(*theta)).alias("cost"))
    flat = F.lit(True)
    for i in range(free):
        flat = flat & (F.abs(F.col(f"s{i}")) < 1e-4)
    return out.select("ID", flat.alias("FLAT"), "cost")


@query("d7_gev_optimum", """
SELECT o_custkey % 20 AS ID, true AS FLAT, true AS BEST FROM orders GROUP BY 1""")
def d7_optimum(cat):
    """Every likelihood fit is at a stationary point and no worse than the L-moment fit.

    Yearly maxima of few years can have no largest likelihood, so the groups here are large.
    """
    orders = cat.table("orders").select((F.col("o_custkey") % 20).alias("ID"), "o_custkey", F.year("o_orderdate").alias("YEAR"),
                                        (F.col("o_totalprice") / 1000).cast("double").alias("VALUE"))
    ym = orders.groupBy("ID", "o_custkey", "YEAR").agg(F.max("VALUE").alias("MAX")).select("ID", "MAX")
    best = _likelihood(ym, fitting.fit_dist(ym, "ID", "MAX", "gev"))
    other = _likelihood(ym, fitting.fit_dist(ym, "ID", "MAX", "gev", "lmoments")).select(F.col("ID").alias("_o"), F.col("cost").alias("other"))
    return best.join(other, F.col("ID") == F.col("_o"), "left").select(
        "ID", "FLAT", (F.coalesce("other", F.lit(float("inf"))) >= F.col("cost") - 1e-6).alias("BEST"))


@query("d8_gev_shape_optimum", with_views("""
SELECT ID, true AS FLAT FROM ym WHERE MAX <> 0 GROUP BY ID HAVING count(DISTINCT MAX) > 1""", "obs_sparse", clean=CLEAN_SPARSE, ym=YM))
def d8_optimum(cat):
    ym = sparse_maxima(cat).withColumn("SHAPE", F.lit(0.1))
    return _likelihood(ym, fitting.fit_dist(ym, "ID", "MAX", "gev", shape="SHAPE"), 2).select("ID", "FLAT")


L_MOMENTS = {
    "pos": """SELECT ID, MAX AS x, row_number() OVER (PARTITION BY ID ORDER BY MAX) AS j,
              count(*) OVER (PARTITION BY ID) AS n FROM ym WHERE MAX <> 0""",
    "pwm": """SELECT ID, any_value(n) AS n, avg(x) AS b0, sum(x * (j - 1) / nullif(n - 1, 0)) / any_value(n) AS b1,
              sum(x * (j - 1) * (j - 2) / nullif((n - 1) * (n - 2), 0)) / any_value(n) AS b2 FROM pos GROUP BY ID""",
    "lm": """SELECT ID, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / nullif(2 * b1 - b0, 0) AS t3 FROM pwm""",
    "hos": """SELECT *, 7.8590 * (2 / (3 + t3) - ln(2) / ln(3)) + 2.9554 * pow(2 / (3 + t3) - ln(2) / ln(3), 2) AS k
              FROM lm WHERE n >= 3 AND l2 > 0""",
    "gl": """SELECT ID, l1 - A * (1 - gamma(1 + k)) / k AS PAR1, A AS PAR2, -k AS PAR3 FROM (
             SELECT *, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS A FROM hos WHERE k > -1)""",
}


@query("d9_l_moments", with_views("""
SELECT ID, n AS N, round(l1, 6) AS L1, round(l2, 6) + 0.0 AS L2, CASE WHEN l2 > 0.000001 THEN round(t3, 8) END AS T3 FROM lm""",
                                  "obs_sparse", clean=CLEAN_SPARSE, ym=YM, **L_MOMENTS))
def d9_moments(cat):
    return fitting.l_moments(sparse_maxima(cat), ["ID"], "MAX").select(
        "ID", big("n").alias("N"), rnd("l1").alias("L1"), (rnd("l2") + 0.0).alias("L2"),
        F.when(F.col("l2") > 0.000001, rnd("t3", 8)).alias("T3"))


GEV_LEVEL = f"PAR1 + PAR2 * (pow(-ln({P}), -PAR3) - 1) / PAR3"


@query("d9_gev_l_moments", with_views(f"""
SELECT ID, NFIT, round(Z, 6) AS PROP_ZERO, round(PAR1, 5) AS PAR1, round(PAR2, 5) AS PAR2, round(PAR3, 5) AS PAR3,
  round(CASE WHEN Z >= 0.98 THEN 0 WHEN PAR1 IS NULL THEN NULL ELSE {GEV_LEVEL} END, 3) AS EVENT50
FROM summ LEFT JOIN gl USING (ID)""", "obs", clean=f"SELECT * FROM obs WHERE {ROW_RULES}", ym=YM, summ=SUMMARY,
                                      **L_MOMENTS))
def d9(cat):
    out = station.station_fits(cat.obs, "gev", "lmoments")
    return out.select("ID", "NFIT", rnd("PROP_ZERO").alias("PROP_ZERO"), *[rnd(f"PAR{i}", 5).alias(f"PAR{i}") for i in (1, 2, 3)],
                      rnd("EVENT50", 3).alias("EVENT50"))


@query("a4_zero_share", with_views("SELECT ID, NFIT, round(Z, 6) AS PROP_ZERO FROM summ", "obs_sparse", **FIT_VIEWS))
def a4(cat):
    return station.station_fits(cat.obs_sparse, "exp").select("ID", "NFIT", rnd("PROP_ZERO").alias("PROP_ZERO"))


@query("a5_prioritized_share", with_views("""
SELECT ID, count(*) AS NFIT, round(sum(CASE WHEN ELEMENT = 'WESD' THEN 1 ELSE 0 END) / count(*), 6) AS PRIORITIZED
FROM (SELECT ID, ELEMENT, YEAR, max(VALUE) AS MAX FROM hy GROUP BY ALL) GROUP BY ID""", "obs_sparse",
                                          clean=CLEAN_SPARSE, hy=f"SELECT *, {wy()} AS YEAR FROM clean"))
def a5(cat):
    ym = maxima.yearly_maximums(qc.clean_station_data(cat.obs_sparse), "ID", "DATE", "VALUE", value_type="ELEMENT")
    return fitting.fit_dist(ym, "ID", "MAX", "exp").select("ID", "NFIT", rnd("PRIORITIZED").alias("PRIORITIZED"))


# --- GEV functions as columns ------------------------------------------------------

@query("c2_return_levels", with_views("""
SELECT ID, CAST(t AS DOUBLE) AS PERIOD, round(PAR1 + PAR2 * (pow(-ln(least(greatest(1 - 1 / t, 1e-6), 1 - 1e-6)), -PAR3) - 1) / PAR3, 3) AS LEVEL
FROM gl, (VALUES (CAST(2 AS DOUBLE)), (10), (50), (100), (10000000)) p(t)""", "obs",
                                      clean=f"SELECT * FROM obs WHERE {ROW_RULES}", ym=YM, **L_MOMENTS))
def c2(cat):
    fits = station.station_fits(cat.obs, "gev", "lmoments").where(F.col("PAR1").isNotNull())
    return fitting.return_levels(fits, "ID", [2, 10, 50, 100, 1e7]).select("ID", "PERIOD", rnd("LEVEL", 3).alias("LEVEL"))


@query("c3_exceedance", with_views("""
SELECT ID, YEAR, MAX, round(1 - exp(-pow(greatest(1 + PAR3 * (MAX - PAR1) / PAR2, 0), -1 / PAR3)), 5) AS P_EXCEED
FROM ym JOIN gl USING (ID)""", "obs", clean=f"SELECT * FROM obs WHERE {ROW_RULES}", ym=YM, **L_MOMENTS))
def c3(cat):
    ym = maxima.yearly_maximums(qc.clean_station_data(cat.obs), "ID", "DATE", "VALUE")
    fits = fitting.fit_dist(ym, "ID", "MAX", "gev", "lmoments").where(F.col("PAR1").isNotNull())
    return fitting.exceedance(ym, fits, "ID", "MAX").where(F.col("P_EXCEED").isNotNull()).select(
        "ID", "YEAR", "MAX", rnd("P_EXCEED", 5).alias("P_EXCEED"))


@query("c3_pgev_inverts_qgev", with_views("""
SELECT k_order, k_line, k_part, k_supp, CASE WHEN p < 1e-6 THEN 1e-6 ELSE round(p, 6) END AS P FROM (
  SELECT *, 1 - l_p AS p FROM (SELECT *, VALUE / 6000 AS l_p FROM obs))""", "obs"))
def c3_inverse(cat):
    shape = (F.month("DATE") - 6) / F.lit(20.0)
    level = extremes.qgev(1 - F.col("VALUE") / 6000, F.lit(10.0), F.lit(3.0), shape)
    return cat.obs.select("k_order", "k_line", "k_part", "k_supp", F.when(
        F.col("VALUE") == 0, 1.0).otherwise(rnd(extremes.pgev(level, 10.0, 3.0, shape))).alias("P"))


@query("c1_month_window", with_views("""
SELECT ID, YEAR, CAST(count(DISTINCT CASE WHEN MONTH IN (11, 12, 1, 2) THEN MONTH END) AS INTEGER) AS WINTER_MONTHS
FROM hy GROUP BY ID, YEAR""", "obs_sparse", clean=CLEAN_SPARSE,
                                     hy=f"SELECT *, {wy()} AS YEAR, month(DATE) AS MONTH FROM clean"))
def c1(cat):
    return sparse_maxima(cat).select("ID", "YEAR", labels.relmonth_count("MONTH_NAMES", [11, 12, 1, 2]).alias("WINTER_MONTHS"))


# --- load percentiles -----------------------------------------------------------------

LEVEL_STATS = """SELECT ID, count(MAX) AS N, count(CASE WHEN MAX > 0 THEN 1 END) AS POS, max(MAX) AS TOP,
  1 - count(CASE WHEN MAX > 0 THEN 1 END) / count(MAX) AS Z, min(CASE WHEN MAX > 0 THEN MAX END) AS LO,
  avg(CASE WHEN MAX > 0 THEN MAX END) AS M, stddev_pop(CASE WHEN MAX > 0 THEN MAX END) AS S,
  avg(CASE WHEN MAX > 0 THEN ln(MAX) END) AS ML, stddev_pop(CASE WHEN MAX > 0 THEN ln(MAX) END) AS SL FROM ym GROUP BY ID"""


def level_sql(fit: str, share: float, digits: int = 4) -> str:
    """One load percentile; ``fit`` uses T, the share left after the zeros."""
    t = f"(({share} - Z) / (1 - Z))"
    return f"""round(CASE WHEN TOP = 0 THEN 0 WHEN POS < 5 THEN TOP WHEN TOP = LO THEN NULL
      WHEN {t} <= 0 THEN 0 ELSE {fit.replace('{T}', t)} END, {digits})"""


@query("d12_normal_levels", with_views(f"""
SELECT ID, {level_sql('exp(ML + SL * (' + qnorm_sql('{T}') + '))', 0.98)} AS LNORM98,
  {level_sql('exp(ML + SL * (' + qnorm_sql('{T}') + '))', 0.99)} AS LNORM99,
  {level_sql('M + S * (' + qnorm_sql('{T}') + ')', 0.98)} AS NORM98 FROM stats""",
                                       "obs_sparse", clean=CLEAN_SPARSE, ym=YM, stats=LEVEL_STATS))
def d12_normal(cat):
    out = fitting.mle_levels(sparse_maxima(cat), "ID", "MAX", {
        "LNORM98": ("lnorm", 0.98), "LNORM99": ("lnorm", 0.99), "NORM98": ("norm", 0.98)})
    return out.select("ID", *[rnd(c, 4).alias(c) for c in ("LNORM98", "LNORM99", "NORM98")])


FAMILY_FORMS = {"weibull": "ln(MAX)", "frechet": "-ln(MAX)", "gumbel": "M - MAX", "revweibull": "ln(TOP + 1 - MAX)"}
FAMILY_LEVELS = {"weibull": "exp(log_scale + ln(-ln(1 - {T})) / k)", "frechet": "exp(-log_scale - ln(-ln({T})) / k)",
                 "gumbel": "M - log_scale - ln(-ln({T})) / k",
                 "revweibull": "TOP + 1 - exp(log_scale + ln(-ln({T})) / k)"}


def _family_sql(name):
    return with_views(f"SELECT ID, {level_sql(FAMILY_LEVELS[name], 0.98)} AS L98, {level_sql(FAMILY_LEVELS[name], 0.99)} AS L99 "
                      "FROM stats LEFT JOIN tk_fit ON ID = G", "obs_sparse", clean=CLEAN_SPARSE, ym=YM, stats=LEVEL_STATS,
                      ysrc=f"SELECT ID AS G, {FAMILY_FORMS[name]} AS y FROM ym JOIN stats USING (ID) WHERE MAX > 0",
                      **tilt_sql("ysrc"))


def _family_query(name, suffix):
    @query(f"{suffix}_{name}_levels", _family_sql(name))
    def run(cat):
        out = fitting.mle_levels(sparse_maxima(cat), "ID", "MAX", {"L98": (name, 0.98), "L99": (name, 0.99)})
        return out.select("ID", rnd("L98", 4).alias("L98"), rnd("L99", 4).alias("L99"))


for _name, _id in (("weibull", "d12b"), ("frechet", "d12c"), ("gumbel", "d12d"), ("revweibull", "d12e")):
    _family_query(_name, _id)


@query("d12a_gamma_levels", with_views(f"""
SELECT ID, {level_sql('x * M / a', 0.98, 3)} AS L98 FROM stats LEFT JOIN gq_fit ON ID = G""", "obs_sparse", clean=CLEAN_SPARSE, ym=YM, stats=LEVEL_STATS,
    gsrc="SELECT ID AS G, M AS m, ML AS ml FROM stats WHERE POS > 4 AND TOP > LO", **gamma_shape_sql("gsrc"),
    qin="SELECT G, (0.98 - Z) / (1 - Z) AS p, k AS a FROM gk15 JOIN stats ON ID = G WHERE (0.98 - Z) / (1 - Z) > 0",
    **gamma_quantile_sql("qin")))
def d12_gamma(cat):
    return fitting.mle_levels(sparse_maxima(cat), "ID", "MAX", {"L98": ("gamma", 0.98)}).select(
        "ID", rnd("L98", 3).alias("L98"))


def load_summary_views(digits: int = 4) -> tuple[dict[str, str], str]:
    """(views, joins and columns over ``ym(ID, MAX)``) of all load columns: a chain per Weibull form, a gamma quantile per share."""
    names = {"DLI": "gumbel", "DLII": "frechet", "DLIII": "revweibull", "DLW": "weibull"}
    views, joins, columns = {}, "", []
    for stem, form in names.items():
        pre = stem.lower()
        views[f"{pre}_y"] = f"SELECT ID AS G, {FAMILY_FORMS[form]} AS y FROM ym JOIN stats USING (ID) WHERE MAX > 0"
        views.update(tilt_sql(f"{pre}_y", prefix=pre))
        views[f"{pre}_c"] = f"SELECT G AS ID, k AS {pre}_k, log_scale AS {pre}_s FROM {pre}_fit"
        joins += f" LEFT JOIN {pre}_c USING (ID)"
        fit = re.sub(r"\bk\b", f"{pre}_k", FAMILY_LEVELS[form].replace("log_scale", f"{pre}_s"))
        columns += [f"{level_sql(fit, 0.98, digits)} AS {stem}", f"{level_sql(fit, 0.99, digits)} AS {stem}2"]
    views["gsrc"] = "SELECT ID AS G, M AS m, ML AS ml FROM stats WHERE POS > 4 AND TOP > LO"
    views.update(gamma_shape_sql("gsrc"))
    for share, pre, stem in ((0.98, "ga", "DLG"), (0.99, "gb", "DLG2")):
        t = f"({share} - Z) / (1 - Z)"
        views[f"{pre}in"] = f"SELECT G, {t} AS p, k AS a FROM gk15 JOIN stats ON ID = G WHERE {t} > 0"
        views.update(gamma_quantile_sql(f"{pre}in", prefix=pre))
        views[f"{pre}_c"] = f"SELECT G AS ID, x / a AS {pre}_x FROM {pre}_fit"
        joins += f" LEFT JOIN {pre}_c USING (ID)"
        columns.append(f"{level_sql(f'{pre}_x * M', share, digits)} AS {stem}")
    log = "exp(ML + SL * (" + qnorm_sql("{T}") + "))"
    columns += [f"{level_sql(log, 0.98, digits)} AS DLL", f"{level_sql(log, 0.99, digits)} AS DLL2"]
    return {"stats": LEVEL_STATS, **views}, (
        f"SELECT ID, N AS numMax, MED AS medMax, TOP AS mMax, {', '.join(columns)} FROM stats "
        f"JOIN (SELECT ID, median(MAX) AS MED FROM ym GROUP BY ID) USING (ID){joins}")


_VIEWS, _SUMMARY = load_summary_views()


@query("d13_load_summary", with_views(_SUMMARY, "obs_sparse", clean=CLEAN_SPARSE, ym=YM, **_VIEWS))
def d13(cat):
    out = fitting.load_summary(sparse_maxima(cat), "ID", "MAX")
    return out.select("ID", "numMax", rnd("medMax").alias("medMax"), rnd("mMax").alias("mMax"),
                      *[rnd(c, 4).alias(c) for c in fitting.LOAD_COLUMNS])
