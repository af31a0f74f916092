"""Calendar columns: water year, season day, snow month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def water_year(date) -> Column:
    """October to December count towards the next year."""
    d = F.col(date) if isinstance(date, str) else date
    return (F.year(d) + F.when(F.month(d) > 9, 1).otherwise(0)).cast("int")


def season_year(date) -> Column:
    """Variant that already moves September forward."""
    d = F.col(date) if isinstance(date, str) else date
    return (F.year(d) + F.when(F.month(d) < 9, 0).otherwise(1)).cast("int")


def season_day(date) -> Column:
    """Signed day of season: autumn days are negative and zero is skipped."""
    d = F.col(date) if isinstance(date, str) else date
    yday = F.dayofyear(d)
    signed = F.when(yday > 250, yday - 366).otherwise(yday)
    return F.when(signed == 0, -1).otherwise(signed).cast("int")


def snow_month(date) -> Column:
    """Months since September, October being 1."""
    d = F.col(date) if isinstance(date, str) else date
    return F.pmod(F.month(d) + 3, F.lit(12)).cast("int")


def log_or_zero(value) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v == 0, 0.0).when(v > 0, F.ln(v))
