"""Monthly and water-year maxima.

Every step is an aggregate with map-side combine, so the first shuffle moves
at most one row per task, station, element and month, and later ones move
yearly rows. Nothing here sorts raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.calendar import water_year


def _largest_first(value: Column, ties) -> Column:
    """Ordering under which ``min_by`` finds the largest value, nulls last."""
    return F.struct(value.isNull().alias("z"), (-value).alias("v"),
                    *[F.col(t) if isinstance(t, str) else t for t in ties])


def monthly_maximums(df: DataFrame, id: str, date: str, value: str,
                     value_type: str | None = None, ties=()) -> DataFrame:
    """The whole row with the largest value per id, type, water year and month.

    Adds MONTH, YEAR (water year) and MAX_N, the number of rows. Ties go to the
    earliest date, then to ``ties``.
    """
    keys = [id] + ([value_type] if value_type else [])
    base = df.drop("MONTH", "YEAR", "MAX_N")
    dated = base.withColumns({"MONTH": F.month(date).cast("int"), "YEAR": water_year(date)})
    rest = [c for c in base.columns if c not in keys]
    out = dated.groupBy(*keys, "YEAR", "MONTH").agg(
        F.min_by(F.struct(*rest), _largest_first(F.col(value), [date, *ties])).alias("_row"),
        F.count(F.lit(1)).alias("MAX_N"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in base.columns],
                      "MONTH", "YEAR", "MAX_N")


def _lean_monthly(df: DataFrame, id, date, value, value_type, ratio, ties) -> DataFrame:
    """Only the columns the yearly step reads; plain hash aggregates."""
    keys = [id] + ([value_type] if value_type else [])
    aggs = [F.max(value).alias(value), F.count(F.lit(1)).alias("MAX_N")]
    if ratio:
        aggs.append(F.min_by(ratio, _largest_first(F.col(value), [date, *ties])).alias(ratio))
    return df.groupBy(*keys, water_year(date).alias("YEAR"),
                      F.month(date).cast("int").alias("MONTH")).agg(*aggs)


def yearly_maximums(df: DataFrame, id: str, date: str | None, value: str,
                    ratio: str | None = None, value_type: str | None = None,
                    prioritize=None, n: int = 10, months: int = 3,
                    monthly: bool = False, ties=()) -> DataFrame:
    """Water-year maxima.

    * no ``value_type``: one row per id and year;
    * ``value_type`` alone: one row per id, type and year;
    * ``value_type`` and ``prioritize``: one row per id and year, taken from the
      prioritised types alone where these have at least ``n`` observations over
      at least ``months`` months and a positive maximum, else from all types.

    MONTH_NAMES lists the months of all types, before that choice. ``monthly``
    says that ``df`` already is the output of :func:`monthly_maximums`.
    """
    if prioritize is not None and value_type is None:
        raise ValueError("prioritize needs value_type")
    mm = df if monthly else _lean_monthly(df, id, date, value, value_type, ratio, ties)

    keys = [id, "YEAR"] if value_type is None or prioritize is not None else [id, value_type, "YEAR"]
    v = F.col(value)
    rank = F.struct(v.isNull().alias("z"), (-v).alias("v"),
                    *([F.col(value_type).alias("t")] if value_type else []),
                    F.col("MONTH").alias("m"))
    seen = F.struct(*([F.col(value_type).alias("t")] if value_type else []), F.col("MONTH").alias("m"))
    bits = F.expr("shiftleft(1, MONTH)")

    def summary(keep: Column, tag: str) -> list[Column]:
        out = [F.max(F.when(keep, v)).alias(f"{tag}_max"),
               F.sum(F.when(keep, F.col("MAX_N"))).alias(f"{tag}_n"),
               F.bit_count(F.bit_or(F.when(keep, bits))).alias(f"{tag}_months"),
               F.min_by("MONTH", F.when(keep, rank)).alias(f"{tag}_month")]
        if ratio:
            out.append(F.min_by(ratio, F.when(keep, rank)).alias(f"{tag}_ratio"))
        return out

    aggs = summary(F.lit(True), "a")
    if prioritize is not None:
        prior = F.col(value_type).isin([prioritize] if isinstance(prioritize, str) else list(prioritize))
        aggs += summary(prior, "p")
        aggs.append(F.min_by(prior, rank).alias("a_prior"))
    aggs.append(F.array_join(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(seen)), lambda s: s["m"].cast("string"))), ":").alias("MONTH_NAMES"))
    wide = mm.groupBy(*keys).agg(*aggs)

    if prioritize is None:
        def pick(name):
            return F.col(f"a_{name}")
    else:
        enough = F.coalesce((F.col("p_n") >= n) & (F.col("p_months") >= months)
                            & (F.col("p_max") > 0), F.lit(False))
        wide = wide.withColumn("_enough", enough)

        def pick(name):
            return F.when(F.col("_enough"), F.col(f"p_{name}")).otherwise(F.col(f"a_{name}"))

    out = [*keys, pick("max").alias("MAX"), pick("n").alias("MAX_N"),
           pick("month").alias("MAX_MONTH"), pick("months").cast("int").alias("MAX_MONTHS")]
    if ratio:
        out.append(pick("ratio").alias("RATIO"))
    if prioritize is not None:
        out.append((F.col("_enough") | F.col("a_prior")).alias("PRIORITIZED"))
    return wide.select(*out, "MONTH_NAMES")


def coverage_filter(ym: DataFrame, id: str, min_nonzero: int = 5, n: int = 10,
                    months: int = 3) -> DataFrame:
    """Ids with enough non-zero maxima; of these, well-covered or large years.

    A year stays with ``n`` observations over ``months`` months, or with a
    maximum not below the median of its id, which is added as MEDIAN.
    """
    stats = ym.groupBy(F.col(id).alias("_id")).agg(
        F.sum(F.when(F.col("MAX") != 0, 1).otherwise(0)).alias("_nonzero"),
        F.median("MAX").alias("MEDIAN")).where(F.col("_nonzero") >= min_nonzero)
    return (ym.join(stats, F.col(id).eqNullSafe(F.col("_id")))
            .where(((F.col("MAX_N") >= n) & (F.col("MAX_MONTHS") >= months))
                   | (F.col("MAX") >= F.col("MEDIAN")))
            .drop("_id", "_nonzero"))
