"""Quality control of daily observations.

The rules run in a fixed order whatever the order of their names:
``mpzero``, ``qflag``, ``month``, ``state_max``, ``county_max``,
``corrupt_years``, ``high_max``. The name ``all`` stands for the first three.

How the plans scale: the first four rules are row filters. ``high_max`` and
``corrupt_years`` reduce the rows to one row per group and year before the
first shuffle and come back as a join with a few bad group-years.
``county_max`` needs the previous observation of a station, element and water
year; raw rows are shuffled once by these three and all its windows share that
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.calendar import water_year
from firnline.operators import rules

RULES = ("mpzero", "qflag", "month", "state_max", "county_max", "corrupt_years", "high_max")
# Fixed value: limits are snow depths; water equivalents get this many times as much.
WATER_MULTIPLIER = 5
# What is sorted as one: the rules start afresh with every water year, so a long record is many pieces.
CHUNK = ["ID", "ELEMENT", "_wy"]


def _element_limit(limit: Column) -> Column:
    return (F.when(F.col("ELEMENT") == "SNWD", limit)
            .when(F.col("ELEMENT") == "WESD", limit * WATER_MULTIPLIER))


def above_state_max(obs: DataFrame, stations: DataFrame, out: str = "_above") -> DataFrame:
    """Mark values beyond the state record; no record, no mark."""
    limits = stations.select("ID", F.col("STATE_MAX").alias("_state_max"))
    marked = obs.join(limits, "ID", "left")
    flag = F.coalesce(F.col("VALUE") > _element_limit(F.col("_state_max")), F.lit(False))
    return marked.withColumn(out, flag).drop("_state_max").select(*obs.columns, out)


def state_max(obs: DataFrame, stations: DataFrame) -> DataFrame:
    return above_state_max(obs, stations).where(~F.col("_above")).select(*obs.columns)


def station_limits(stations: DataFrame, county_maxes: DataFrame) -> DataFrame:
    """One row per station with its county limits as a map of day gap to limit.

    Of several limits for a gap the smallest counts. Missing names match missing names.
    """
    smallest = county_maxes.where(F.col("DAYS").isNotNull()).groupBy(
        F.col("STATE").alias("_state"), F.col("COUNTY").alias("_county"), F.col("DAYS").cast("int").alias("days")).agg(
        F.min("COUNTY_MAX").alias("limit"))
    limits = smallest.groupBy("_state", "_county").agg(
        F.map_from_entries(F.collect_list(F.struct("days", "limit"))).alias("_limits"))
    same = F.col("STATE").eqNullSafe(F.col("_state")) & F.col("COUNTY").eqNullSafe(F.col("_county"))
    return stations.select("ID", "STATE", "COUNTY").join(limits, same, "left").select("ID", "_limits")


def _rise_flag(value: Column, prev_value: Column, days: Column, multiplier: float) -> Column:
    """Null where the value repeats (the earlier flag then carries on)."""
    rise = F.coalesce(value - prev_value, value)
    limit = _element_limit(F.try_element_at(F.col("_limits"), F.coalesce(days, F.lit(1))))
    return (F.when(value == prev_value, F.lit(None).cast("boolean"))
            .when(limit.isNull(), F.lit(False))
            .otherwise(rise > limit * multiplier))


def daily_steps(obs: DataFrame, order=("DATE",)) -> DataFrame:
    """DAYS since and VDIFF from the previous row of a station, element and water year.

    The first row of a year has a gap of one day and its whole value as the rise.
    """
    before = F.lag(F.struct("VALUE", "DATE")).over(Window.partitionBy(*CHUNK).orderBy(*order))
    both = obs.withColumn("_wy", water_year("DATE")).withColumn("_prev", before)
    return both.select(
        *obs.columns, F.col("_wy").alias("YEAR"),
        F.coalesce(F.datediff("DATE", F.col("_prev.DATE")), F.lit(1)).alias("DAYS"),
        F.coalesce(F.col("VALUE") - F.col("_prev.VALUE"), F.col("VALUE")).alias("VDIFF"))


def above_county_max(obs: DataFrame, stations: DataFrame, county_maxes: DataFrame,
                     multiplier: float = 1.0, order=("DATE",), out: str = "_above") -> DataFrame:
    """Mark rises beyond the county limit for their day gap.

    A value that repeats the one before inherits its mark. Identical rows share
    one fate. ``order`` has to be a total order within a station, element and
    year, up to identical rows.
    """
    w = Window.partitionBy(*CHUNK).orderBy(*order)
    rows = obs.join(station_limits(stations, county_maxes), "ID", "left").withColumn("_wy", water_year("DATE"))
    stepped = rows.withColumn("_prev", F.lag(F.struct("VALUE", "DATE")).over(w)).withColumn(
        "_step", _rise_flag(F.col("VALUE"), F.col("_prev.VALUE"), F.datediff("DATE", F.col("_prev.DATE")), multiplier))
    carried = F.last("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = stepped.drop("_limits", "_prev").withColumn("_one", F.coalesce(carried, F.lit(False)))
    # The same partitioning again, so this window costs a sort and no shuffle.
    twins = Window.partitionBy(*CHUNK, *[c for c in obs.columns if c not in CHUNK])
    return flagged.withColumn(out, F.max("_one").over(twins)).select(*obs.columns, out)


def county_max(obs: DataFrame, stations: DataFrame, county_maxes: DataFrame,
               multiplier: float = 1.0, order=("DATE",)) -> DataFrame:
    marked = above_county_max(obs, stations, county_maxes, multiplier, order)
    return marked.where(~F.col("_above")).select(*obs.columns)


def corrupt_group_years(marked: DataFrame, threshold: float, out: str = "_above") -> DataFrame:
    """(ID, water year) pairs that lost too many rows to the rules marked in ``out``."""
    counts = (marked.groupBy("ID", water_year("DATE").alias("_wy"))
              .agg(F.count(F.lit(1)).alias("_n"),
                   F.sum(F.when(F.col(out), 0).otherwise(1)).alias("_kept")))
    if threshold < 1:
        bad = F.col("_kept") / F.col("_n") <= 1 - threshold
    else:
        bad = F.col("_n") - F.col("_kept") >= threshold
    return counts.where(bad).select("ID", "_wy")


def corrupt_years(marked: DataFrame, threshold: float, out: str = "_above") -> DataFrame:
    """Unmarked rows outside the corrupt years."""
    bad = corrupt_group_years(marked, threshold, out)
    rest = marked.where(~F.col(out)).withColumn("_wy", water_year("DATE"))
    return rest.join(bad, ["ID", "_wy"], "left_anti").drop("_wy", out)


def _yearly_maxima(obs: DataFrame, group: str) -> DataFrame:
    return obs.groupBy(F.col(group).alias("_g"), water_year("DATE").alias("_wy")).agg(F.max("VALUE").alias("_max"))


def _cutoffs(yearly: DataFrame, iqr_cutoff: float) -> DataFrame:
    log = F.ln(F.col("_max") + 1)
    spread = yearly.groupBy(F.col("_g").alias("_group")).agg(
        F.percentile(log, F.lit(0.75)).alias("Q75"), F.percentile(log, F.lit(0.25)).alias("Q25"), F.max(log).alias("_top"))
    iqr = F.col("Q75") - F.col("Q25")
    cutoff = (F.when(F.exp("Q75") - F.exp("Q25") < 1, F.col("_top"))
              .otherwise(F.col("Q75") + F.lit(float(iqr_cutoff)) * iqr))
    return spread.select("_group", "Q75", "Q25", iqr.alias("IQR"), cutoff.alias("CUTOFF"))


def high_max_cutoffs(obs: DataFrame, group: str = "ID", iqr_cutoff: float = 3) -> DataFrame:
    """Per group: quartiles of the log yearly maxima and the cutoff above them.

    Where the quartiles are less than one unit apart the cutoff is the largest
    maximum, which nothing can exceed.
    """
    return _cutoffs(_yearly_maxima(obs, group), iqr_cutoff).withColumnRenamed("_group", group)


def high_max_group_years(obs: DataFrame, group: str = "ID", iqr_cutoff: float = 3,
                         max_yearly_outliers: int = 5) -> DataFrame:
    """(group, water year, CUTOFF) where a few values lie above the cutoff.

    A year with ``max_yearly_outliers`` or more such values is believed. The
    yearly maxima are reduced once, for the cutoffs and for the suspects.
    """
    yearly = _yearly_maxima(obs, group)
    cut = _cutoffs(yearly, iqr_cutoff).select("_group", "CUTOFF")
    suspects = (yearly.join(cut, F.col("_g").eqNullSafe(F.col("_group")))
                .where(F.ln(F.col("_max") + 1) > F.col("CUTOFF"))
                .select("_group", "_wy", "CUTOFF"))
    seen = obs.select(F.col(group).alias("_g"), water_year("DATE").alias("_y"), "VALUE")
    return (seen.join(suspects, F.col("_g").eqNullSafe(F.col("_group"))
                      & (F.col("_y") == F.col("_wy")))
            .where(F.ln(F.col("VALUE") + 1) > F.col("CUTOFF"))
            .groupBy("_group", "_wy", "CUTOFF").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") < max_yearly_outliers)
            .select("_group", "_wy", "CUTOFF"))


def high_max(obs: DataFrame, group: str = "ID", iqr_cutoff: float = 3,
             max_yearly_outliers: int = 5) -> DataFrame:
    """Drop isolated values far above the group's usual yearly maxima."""
    bad = high_max_group_years(obs, group, iqr_cutoff, max_yearly_outliers)
    rows = obs.withColumn("_y", water_year("DATE"))
    hit = (rows[group].eqNullSafe(bad["_group"]) & (rows["_y"] == bad["_wy"])
           & (F.ln(rows["VALUE"] + 1) > bad["CUTOFF"]))
    return rows.join(bad, hit, "left_anti").drop("_y")


def _check(clean, yearly_threshold) -> set[str]:
    names = {clean} if isinstance(clean, str) else set(clean)
    unknown = names - set(RULES) - {"all"}
    if unknown:
        raise ValueError(f"unknown cleaning rules: {sorted(unknown)}")
    if "high_max" in names and names & {"state_max", "county_max"}:
        raise ValueError("high_max needs comparable units, state_max and county_max raw "
                         "ones: they cannot be combined")
    if "corrupt_years" in names and (yearly_threshold is None or yearly_threshold <= 0):
        raise ValueError("corrupt_years needs a positive yearly_threshold")
    return names


def clean_station_data(obs: DataFrame, clean="all", months=(7, 8, 9), max_grouping: str = "ID",
                       iqr_cutoff: float = 3, max_yearly_outliers: int = 5,
                       county_multiplier: float = 1, yearly_threshold: float | None = None,
                       stations: DataFrame | None = None, county_maxes: DataFrame | None = None,
                       order=("DATE",)) -> DataFrame:
    """Apply the named rules and return the surviving rows with unchanged columns."""
    names = _check(clean, yearly_threshold)
    everything = "all" in names
    if everything or "mpzero" in names:
        obs = rules.drop_presumed_zero(obs)
    if everything or "qflag" in names:
        obs = rules.keep_unflagged(obs)
    if everything or "month" in names:
        obs = rules.drop_months(obs, months)

    columns = obs.columns
    marks = []
    if "state_max" in names:
        obs = above_state_max(obs, stations, out="_over_state")
        marks.append("_over_state")
    if "county_max" in names:
        # The previous observation is the previous one that survived state_max.
        seen = obs.where(~F.col("_over_state")).drop("_over_state") if marks else obs
        over = above_county_max(seen, stations, county_maxes, county_multiplier, order,
                                out="_over_county")
        if marks:
            lost = obs.where(F.col("_over_state")).select(
                *columns, F.lit(True).alias("_over_county"))
            over = over.unionByName(lost)
        obs = over
        marks = ["_over_county"]
    if "corrupt_years" in names:
        marked = obs.withColumnRenamed(marks[0], "_above") if marks else obs.withColumn(
            "_above", F.lit(False))
        obs = corrupt_years(marked, yearly_threshold)
    elif marks:
        obs = obs.where(~F.col(marks[0])).drop(marks[0])
    if "high_max" in names:
        obs = high_max(obs, max_grouping, iqr_cutoff, max_yearly_outliers)
    return obs.select(*columns)


def removal_report(obs: DataFrame, months=(7, 8, 9), stations: DataFrame | None = None) -> DataFrame:
    """Rows in, and rows each row-wise rule would take after the ones before it."""
    if stations is not None:
        obs = above_state_max(obs, stations)
    else:
        obs = obs.withColumn("_above", F.lit(False))
    first = (F.when(F.col("MFLAG") == "P", "mpzero")
             .when(F.col("QFLAG").isNotNull() & ~F.col("QFLAG").isin("", " "), "qflag")
             .when(F.month("DATE").isin(*months), "month")
             .when(F.col("_above"), "state_max")
             .otherwise("kept"))
    return obs.groupBy(first.alias("RULE")).agg(F.count(F.lit(1)).alias("N"))


def rule_losses(obs: DataFrame, clean="all", **options) -> DataFrame:
    """(RULE, N): rows that each of the named rules takes after the ones before it, and those kept.

    ``options`` are those of :func:`clean_station_data`. One count for each rule.
    """
    names = _check(clean, options.get("yearly_threshold"))
    chain = [r for r in RULES if r in names or ("all" in names and r in RULES[:3])]
    left = [obs] + [clean_station_data(obs, chain[:k + 1], **options) for k in range(len(chain))]
    counts = [df.agg(F.lit(k).alias("_k"), F.count(F.lit(1)).alias("_n")) for k, df in enumerate(left)]
    every = counts[0]
    for one in counts[1:]:
        every = every.union(one)
    # A row for each rule and one for the rest: the window sees eight rows at most.
    after = every.withColumn("_next", F.lead("_n").over(Window.orderBy("_k")))
    labels = F.array(*[F.lit(r) for r in [*chain, "kept"]])
    return after.select(F.element_at(labels, F.col("_k") + 1).alias("RULE"), F.coalesce(F.col("_n") - F.col("_next"), F.col("_n")).alias("N"))
