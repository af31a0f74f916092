"""Distribution functions as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of algorithm AS 241 (PPND16) for the normal
# quantile, lowest power first: central region, middle tail, far tail.
AS241_CENTRE_NUM = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
                    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
                    3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_CENTRE_DEN = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
                    5.2264952788528545610e3]
AS241_TAIL_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
                  3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
                  2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_TAIL_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
                  1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
                  1.05075007164441684324e-9]
AS241_FAR_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
                 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
                 2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_FAR_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
                 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
                 2.04426310338993978564e-15]

# Lanczos approximation of the gamma function (g = 7, 9 terms).
LANCZOS_G = 7
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7]

# Fixed value: below this absolute shape the Gumbel limit is used.
SHAPE_EPS = 1e-8


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def polynomial_text(coefficients, x: str, suffix: str = "D") -> str:
    """Horner form as SQL text, lowest power first; one parse instead of many Column calls."""
    text = f"{coefficients[-1]!r}{suffix}"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}{suffix})"
    return text


def _ratio_text(num, den, x: str) -> str:
    return f"{polynomial_text(num, x)} / {polynomial_text(den, x)}"


def with_qnorm(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the standard normal quantile of ``p``: infinite at 0 and 1, null outside.

    Intermediate results get projections of their own, so each is evaluated once.
    """
    staged = df.withColumn("_qp", p).selectExpr(
        "*", "_qp - 0.5D AS _qq", "sqrt(-ln(least(_qp, 1 - _qp))) AS _qr").selectExpr(
        "*", "0.180625D - _qq * _qq AS _qc", "_qr - 1.6D AS _qt", "_qr - 5D AS _qf")
    value = f"""CASE WHEN _qp = 0 THEN double('-Infinity') WHEN _qp = 1 THEN double('Infinity')
      WHEN _qp > 0 AND _qp < 1 THEN CASE
        WHEN abs(_qq) <= 0.425D THEN _qq * {_ratio_text(AS241_CENTRE_NUM, AS241_CENTRE_DEN, '_qc')}
        ELSE sign(_qq) * CASE WHEN _qr <= 5 THEN {_ratio_text(AS241_TAIL_NUM, AS241_TAIL_DEN, '_qt')}
          ELSE {_ratio_text(AS241_FAR_NUM, AS241_FAR_DEN, '_qf')} END END END"""
    return staged.withColumn(out, F.expr(value)).drop("_qp", "_qq", "_qr", "_qc", "_qt", "_qf")


def gamma_function(x) -> Column:
    """Gamma function for positive arguments."""
    z = _col(x) - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + i)
    t = z + (LANCZOS_G + 0.5)
    return F.sqrt(F.lit(2 * 3.141592653589793)) * F.pow(t, z + 0.5) * F.exp(-t) * series


def qexp(p, rate) -> Column:
    return F.try_divide(-F.ln(1 - _col(p)), _col(rate))


def qgumbel(p, loc, scale) -> Column:
    return _col(loc) - _col(scale) * F.ln(-F.ln(_col(p)))


def qgev_exact(p, loc, scale, shape) -> Column:
    """GEV quantile without any clamping of ``p``."""
    p, loc, scale, shape = map(_col, (p, loc, scale, shape))
    y = -F.ln(p)
    bent = loc + scale * F.try_divide(F.pow(y, -shape) - 1, shape)
    return F.when(F.abs(shape) < SHAPE_EPS, loc - scale * F.ln(y)).otherwise(bent)


def qgev(p, loc=0.0, scale=1.0, shape=0.0, tol: float = 1e-6) -> Column:
    """GEV quantile with probabilities held inside [tol, 1 - tol]."""
    p = _col(p)
    clamped = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - tol)), F.lit(tol)))
    return qgev_exact(clamped, loc, scale, shape)


def pgev(x, loc=0.0, scale=1.0, shape=0.0) -> Column:
    """GEV distribution function; 0 or 1 beyond the end of the support."""
    x, loc, scale, shape = map(_col, (x, loc, scale, shape))
    s = F.try_divide(x - loc, scale)
    support = F.greatest(1 + shape * s, F.lit(0.0))
    bent = F.exp(-F.pow(support, F.try_divide(F.lit(-1.0), shape)))
    return F.when(F.abs(shape) < SHAPE_EPS, F.exp(-F.exp(-s))).when(s.isNotNull(), bent)
