import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import correlation

OBS = "ID long, DATE date, ELEMENT string, VALUE double"


def joined(pairs, obs, zero_free=("SNWD", "WESD")):
    """By the definition: a row for each two observations of a day."""
    rows = obs.where(~F.col("ELEMENT").isin(*zero_free) | (F.col("VALUE") != 0))
    a = rows.select(F.col("ID").alias("ID1"), "DATE", "ELEMENT", F.col("VALUE").alias("_a"))
    b = rows.select(F.col("ID").alias("ID2"), "DATE", "ELEMENT", F.col("VALUE").alias("_b"))
    stats = pairs.select("ID1", "ID2").join(a, "ID1").join(b, ["ID2", "DATE", "ELEMENT"]).groupBy("ID1", "ID2", "ELEMENT").agg(
        F.count(F.lit(1)).alias("N"), F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    return (pairs.join(stats, ["ID1", "ID2"]).withColumn("pcorr", F.try_divide("_c", F.col("_sa") * F.col("_sb")))
            .where("pcorr is not null").drop("_c", "_sa", "_sb"))


@pytest.mark.parametrize("with_places", [False, True])
def test_correlation_of_blocks_is_that_of_joined_days(spark, with_places):
    r = np.random.default_rng(2)
    rows = []
    for i in range(70):
        for d in map(int, r.choice(3000, 25 + i % 40, replace=False) if i % 3 else range(900, 980)):
            v = {0: float(r.integers(0, 9)), 1: 0.1, 2: 1e6 + float(r.normal()), 3: float(r.normal())}[i % 4]
            rows.append((i, int(d), ("SNWD", "TMIN")[i % 5 == 0 or d % 2], v))
            rows += [rows[-1]] * (r.random() < 0.1) + [(i, int(d), "TMIN", float(r.normal()))] * (r.random() < 0.1)
            rows += [(i, int(d), "TMIN", None)] * (r.random() < 0.05) + [(i, int(d), "TMIN", math.nan)] * (i == 9 and d % 40 == 0)
    rows = [(17 * i, *rest) for i, *rest in rows] + [(i, 950, "TMIN", 1.0) for i in range(1190) if i % 17]  # more than a block
    rows += [(None, 3, "TMIN", 1.0), (5, 3, None, 1.0)]
    obs = spark.createDataFrame(rows, "ID long, d int, ELEMENT string, VALUE double").select(
        "ID", F.date_add(F.lit("1969-01-01"), F.col("d")).alias("DATE"), "ELEMENT", "VALUE")
    codes = [(17 * int(a), 17 * int(b), float(a + b)) for a, b in r.integers(0, 75, (600, 2)) if a != b] + [(51, 153, 1.0), (51, 153, 2.0), (153, 51, 1.0), (None, 51, 1.0)]
    pairs = spark.createDataFrame(codes, "ID1 long, ID2 long, DIST double")
    places = spark.createDataFrame([(17 * i, float(i % 7), float(i % 5), None if i == 4 else float(i)) for i in range(60)] + [(17, 1.0, 1.0, 1.0)],
                                   "ID long, LONGITUDE double, LATITUDE double, ELEVATION double") if with_places else None
    want = sorted(map(tuple, joined(pairs, obs).collect()), key=lambda t: t[:4])
    got = sorted(map(tuple, correlation.pair_correlation(pairs, obs, places=places).collect()), key=lambda t: t[:4])
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(want) > 80
    for g, w in zip(got, want):
        assert (math.isnan(g[5]) and math.isnan(w[5])) or g[5] == pytest.approx(w[5], abs=1e-6)
    assert any(math.isnan(w[5]) for w in want)


def test_days_of_pairs_are_not_joined(spark):
    obs = spark.createDataFrame([(i, None, "SNWD", 1.0) for i in range(3)], OBS)
    pairs = spark.createDataFrame([(0, 1, 1.0)], "ID1 long, ID2 long, DIST double")
    plan = correlation.pair_correlation(pairs, obs)._jdf.queryExecution().executedPlan().toString()
    assert "DATE" not in plan and "CoGroups" in plan
