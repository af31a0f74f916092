"""Wide to long, split columns, names and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The day columns of the wide county table, for gaps of 1 to 10 days.
DAY_COLUMNS = ["one.day.value", "two.day.value", "three.day.value", "four.day.value", "five.day.value",
               "six.day.value", "seven.day.value", "eight.day.value", "nine.day.value", "ten.day.value"]


def county_limits_long(wide: DataFrame, day_columns=DAY_COLUMNS) -> DataFrame:
    """One row per state, county and day gap from one row per county."""
    long = wide.unpivot(["state", "`county.name`"], [f"`{c}`" for c in day_columns], "_day", "COUNTY_MAX")
    days = F.create_map(*[e for i, c in enumerate(day_columns, 1) for e in (F.lit(c), F.lit(i))])
    return long.select(F.col("state").alias("STATE"), F.col("`county.name`").alias("COUNTY"),
                       days[F.col("_day")].alias("DAYS"), F.col("COUNTY_MAX").cast("double").alias("COUNTY_MAX"))


def extend_limits(wide: DataFrame, day_columns=DAY_COLUMNS, known: int = 3) -> DataFrame:
    """Fill the day columns beyond the ``known`` ones in proportion to the last known one."""
    last = F.col(f"`{day_columns[known - 1]}`") / known
    for i, c in enumerate(day_columns[known:], known + 1):
        wide = wide.withColumn(c, last * i)
    return wide


def split_column(df: DataFrame, column: str, into, sep: str = ",", types=None) -> DataFrame:
    """Replace a delimited column by its parts; missing parts are null."""
    parts = F.split(F.col(column), sep)
    out = []
    for i, name in enumerate(into):
        part = F.get(parts, F.lit(i))
        out.append((part if types is None else part.try_cast(types[i])).alias(name))
    return df.select(*[c for c in df.columns if c != column], *out)


def state_abbreviation(full: Column, names: dict[str, str], special=None) -> Column:
    """Abbreviation of a state name written in any case; unknown names are null."""
    table = {**names, **(special or {})}
    lookup = F.create_map(*[e for k, v in table.items() for e in (F.lit(k), F.lit(v))])
    return F.try_element_at(lookup, F.initcap(full))


# Upper ends of the distance classes in km; a class includes its upper end.
DISTANCE_CLASSES = [0, 2.5, 5, 10, 20, 30]


def distance_class(km: Column, ends=DISTANCE_CLASSES) -> Column:
    """Text such as "(2.5,5]"; null outside all classes."""
    out = F.lit(None).cast("string")
    for low, high in zip(ends, ends[1:]):
        out = F.when((km > low) & (km <= high), f"({low:g},{high:g}]").otherwise(out)
    return out


def row_median(*columns, digits: int | None = None) -> Column:
    """Median across columns of a row, nulls left out."""
    values = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull()))
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    median = (low + high) / 2
    return median if digits is None else F.bround(median, digits)
