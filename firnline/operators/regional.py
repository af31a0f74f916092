"""Models per region and predictions blended over region borders.

Distances come as a long table (row id, region_id, dist_km). The linear model
is a sum of products per region, so a region with a third of all rows costs
the same single aggregate. A user's own model is fitted the same way if it can
be put together from parts, see :class:`MergeableModel`; a plain function is
called once per region with that region's rows, see :func:`function_models`.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.functions import geodesy as geo
from firnline.operators import spatial
from firnline.session import Scratch, cut_lineage


def check_names(value, regions: DataFrame, name: str, needed: DataFrame | None = None) -> None:
    """Numbers per region have to name known regions, and all those that are needed (by default all)."""
    if not isinstance(value, dict):
        return
    known = regions.select(F.col("region_id").cast("string").alias("region_id")).distinct()
    listed = [str(k) for k in value]
    every = known if needed is None else needed.select("region_id").distinct()
    missing = every.where(~F.col("region_id").isin(listed)).limit(5).collect()
    if missing:
        raise ValueError(f"{name} lacks regions: {[r.region_id for r in missing]}")
    found = {r.region_id for r in known.where(F.col("region_id").isin(listed)).collect()}
    if set(listed) - found:
        raise ValueError(f"{name} has unknown regions: {sorted(set(listed) - found)}")


def _per_region(value) -> Column:
    """A number for all regions, or a dict of region to number."""
    if isinstance(value, dict):
        if not value:
            raise ValueError("empty region table")
        pairs = [e for k, v in value.items() for e in (F.lit(str(k)), F.lit(float(v)))]
        return F.try_element_at(F.create_map(*pairs), F.col("region_id"))
    return F.lit(float(value))


def nearest_rows(distances: DataFrame, id: str, n: int) -> DataFrame:
    """The ``n`` nearest rows of each region.

    Spark limits each task's output to ``n`` rows per region before the shuffle.
    """
    w = Window.partitionBy("region_id").orderBy("dist_km", id)
    return distances.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def membership(distances: DataFrame, id: str, buffer, min_n: int = 0) -> DataFrame:
    """Training rows of each region: (region_id, id).

    Regions without a row inside (distance 0) have no model. A row trains every
    region it is nearer to than the buffer; where that gives fewer than
    ``min_n`` rows the ``min_n`` nearest are taken instead.
    """
    near = F.col("dist_km") < _per_region(buffer)
    counts = distances.groupBy("region_id").agg(
        F.sum(F.when(F.col("dist_km") == 0, 1).otherwise(0)).alias("_inside"),
        F.sum(F.when(near, 1).otherwise(0)).alias("_near")).where(F.col("_inside") > 0)
    marked = distances.join(counts.select("region_id", "_near"), "region_id")
    enough = marked.where((F.col("_near") >= min_n) & near).select("region_id", id)
    if min_n <= 0:
        return enough
    short = nearest_rows(marked.where(F.col("_near") < min_n), id, min_n).select("region_id", id)
    return enough.union(short)


#: What a radius grows by that had too few rows, and the least it grows to.
GROWTH, LEAST_KM = 4.0, 100.0


def training_rows(data: DataFrame, edges: DataFrame, id: str, buffer, min_n: int = 0,
                  lon: str = "LONGITUDE", lat: str = "LATITUDE", need_inside: bool = True) -> DataFrame:
    """``membership`` without the distances of all rows to all regions.

    Without ``need_inside`` regions that no row is inside of count too; with a
    buffer of 0 the result is then the ``min_n`` nearest rows of each region.

    Rows within the largest buffer come first. Regions that miss ``min_n`` get
    a radius of their own, grown until so many rows are within it: then the
    nearest are among them for certain. Only those regions are looked at again.
    """
    half_globe = math.pi * geo.POLYGON_RADIUS_KM
    radius = float(max(buffer.values()) if isinstance(buffer, dict) else buffer)
    with Scratch(data.sparkSession) as scratch:
        known = scratch.cut(spatial.distances_within(data, edges, id, radius, lon, lat))
        near = F.col("dist_km") < _per_region(buffer)
        counts = scratch.cut(known.groupBy("region_id").agg(
            F.sum(F.when(F.col("dist_km") == 0, 1).otherwise(0)).alias("_inside"),
            F.sum(F.when(near, 1).otherwise(0)).alias("_near")))
        if need_inside:
            counts = counts.where(F.col("_inside") > 0)
        else:
            counts = edges.select("region_id").distinct().join(counts, "region_id", "left").fillna(0, ["_inside", "_near"])
        enough = counts.where(F.col("_near") >= min_n).select("region_id")
        found = [known.join(enough, "region_id", "left_semi").where(near).select("region_id", id)]
        short = scratch.cut(counts.where(F.col("_near") < min_n).select("region_id"))
        while min_n > 0 and not short.isEmpty():
            have = known.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n"))
            have = short.join(have, "region_id", "left").where((F.coalesce("_n", F.lit(0)) >= min_n) | F.lit(radius >= half_globe))
            ready = scratch.cut(have.select("region_id"))
            found.append(nearest_rows(known.join(ready, "region_id", "left_semi"), id, min_n).select("region_id", id))
            short = scratch.cut(short.join(ready, "region_id", "left_anti"))
            radius = max(GROWTH * radius, LEAST_KM)
            if not short.isEmpty():
                known = scratch.cut(spatial.distances_within(data, edges.join(short, "region_id", "left_semi"), id, min(radius, half_globe), lon, lat))
        return cut_lineage(reduce(DataFrame.union, found))


# --- linear models --------------------------------------------------------------------

def linear_models(data: DataFrame, members: DataFrame, id: str, y: str, x) -> DataFrame:
    """Least squares of ``y`` on ``x`` per region: (region_id, coef array, n_train, error).

    The intercept is the first coefficient. Rows with a null take no part. All
    that is needed of the rows are their means and covariances, which Spark
    aggregates in parallel; one small solve per region follows.
    """
    x = list(x)
    size = len(x)
    rows = members.join(data.select(id, y, *x).dropna(), id)
    sums = rows.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_train"), F.avg(y).alias("_y"),
        F.array(*[F.avg(c) for c in x]).cast("array<double>").alias("_x"),
        F.array(*[F.covar_pop(a, b) for a in x for b in x]).cast("array<double>").alias("_xx"),
        F.array(*[F.covar_pop(c, y) for c in x]).cast("array<double>").alias("_xy"))

    @F.pandas_udf("array<double>")
    def solve(mean_y: pd.Series, mean_x: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for my, mx, a, b in zip(mean_y, mean_x, xx, xy):
            a = np.asarray(a, float).reshape(size, size)
            spread = np.sqrt(np.diag(a))
            if size and (np.any(spread == 0) or np.linalg.matrix_rank(a / np.outer(spread, spread)) < size):
                out.append(None)
                continue
            beta = np.linalg.solve(a, np.asarray(b, float)) if size else np.zeros(0)
            out.append([float(my - np.dot(beta, np.asarray(mx, float))), *beta.tolist()])
        return pd.Series(out)

    return sums.select("region_id", solve("_y", "_x", "_xx", "_xy").alias("coef"), "n_train").withColumn(
        "error", F.when(F.col("coef").isNull(), F.lit("predictors are not independent")))


def linear_prediction(x) -> Column:
    total = F.col("coef")[0]
    for i, c in enumerate(x, start=1):
        total = total + F.col("coef")[i] * F.col(c)
    return total


# --- the user's own model -----------------------------------------------------------------

#: Partial states of a region that are merged in one place at first.
FAN = 64
#: States that a task holds before it sends them on, and rows that a prediction gets at a time, about.
HELD, PIECE = 10_000, 50_000


class MergeableModel(Protocol):
    """A model that is fitted in parts. States and the model have to pickle."""

    def init(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, rows: pd.DataFrame) -> Any:
        """The state with some more rows of the region; in what order and portions they come is not known."""

    def merge(self, a: Any, b: Any) -> Any:
        """The state of the rows of both."""

    def finish(self, state: Any) -> Any:
        """The model."""


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def mergeable_models(data: DataFrame, members: DataFrame, id: str, model: MergeableModel) -> DataFrame:
    """``model`` fitted per region: (region_id, model, n_train, error).

    Rows stay in the partitions they are in: a task updates a state for each
    region it meets, batch by batch. Only states are shuffled, and merged in
    two levels, some of a region first and what is left of it then. An
    exception becomes that region's error.
    """
    rows = members.join(data, id)
    schema = "region_id string, part int, state binary, n bigint, error string"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}

        def sent() -> pd.DataFrame:
            return pd.DataFrame([(r, part, None if e else pickle.dumps(s), n, e) for r, (s, n, e) in held.items()],
                                columns=["region_id", "part", "state", "n", "error"])
        for batch in batches:
            for region, some in batch.groupby("region_id", sort=False):
                now = held.setdefault(region, [None, 0, None])
                now[1] += len(some)
                if now[2] is None:
                    try:
                        now[0] = model.update(model.init() if now[0] is None else now[0], some.drop(columns="region_id").reset_index(drop=True))
                    except Exception as e:  # noqa: BLE001 - a failing region must not stop the others
                        now[0], now[2] = None, _said(e)
            if len(held) >= HELD:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def united(pdf: pd.DataFrame) -> tuple[Any, int, str | None]:
        state, error = None, next((e for e in pdf["error"] if e is not None), None)
        try:
            for data_ in pdf["state"] if error is None else ():
                one = pickle.loads(data_)
                state = one if state is None else model.merge(state, one)
        except Exception as e:  # noqa: BLE001
            state, error = None, _said(e)
        return state, int(pdf["n"].sum()), error

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n, error = united(pdf)
        return pd.DataFrame({"region_id": [pdf["region_id"].iloc[0]], "part": [0], "state": [None if error else pickle.dumps(state)], "n": [n], "error": [error]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n, error = united(pdf)
        fitted = None
        if error is None:
            try:
                fitted = pickle.dumps(model.finish(state))
            except Exception as e:  # noqa: BLE001
                error = _said(e)
        return pd.DataFrame({"region_id": [pdf["region_id"].iloc[0]], "model": [fitted], "n_train": [n], "error": [error]})

    parts = rows.mapInPandas(partial, schema)
    first = parts.groupBy("region_id", F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(lambda key, pdf: some(pdf), schema)
    return first.groupBy("region_id").applyInPandas(last, "region_id string, model binary, n_train bigint, error string")


def function_models(data: DataFrame, members: DataFrame, id: str, fit) -> DataFrame:
    """``fit(pandas rows) -> model`` per region: (region_id, model, n_train, error).

    An exception in ``fit`` becomes that region's error. Such a function needs
    its region's rows in one place; no region is left out, so the largest has to
    fit a task. :func:`mergeable_models` and :func:`linear_models` have no such need.
    """
    rows = members.join(data, id)
    schema = "region_id string, model binary, n_train bigint, error string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        region = pdf["region_id"].iloc[0]
        try:
            model, error = pickle.dumps(fit(pdf.drop(columns="region_id"))), None
        except Exception as e:  # noqa: BLE001 - a failing region must not stop the others
            model, error = None, _said(e)
        return pd.DataFrame({"region_id": [region], "model": [model], "n_train": [len(pdf)], "error": [error]})

    return rows.groupBy("region_id").applyInPandas(one, schema)


def function_predictions(scored: DataFrame, models: DataFrame, id: str, predict, piece: int | None = None) -> DataFrame:
    """``predict(model, pandas rows) -> values`` for (region, row) pairs: (id, region_id, pred).

    Rows of a region are dealt into pieces of about ``piece`` rows, by how many
    it has, each with its own copy of the model.
    """
    pieces = scored.groupBy("region_id").agg(F.ceil(F.count(F.lit(1)) / (piece or PIECE)).alias("_k"))
    usable = models.where(F.col("model").isNotNull()).select("region_id", "model").join(pieces, "region_id").withColumn(
        "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k")
    rows = scored.join(pieces, "region_id").withColumn("_s", F.pmod(F.xxhash64(id), F.col("_k"))).drop("_k")
    schema = T.StructType([scored.schema[id], T.StructField("region_id", T.StringType()),
                           T.StructField("pred", T.DoubleType())])

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (id, "region_id", "pred")})
        model = pickle.loads(right["model"].iloc[0])
        values = np.asarray(predict(model, left.drop(columns="_s")), float)
        return pd.DataFrame({id: left[id].to_numpy(), "region_id": left["region_id"].to_numpy(), "pred": values})

    return rows.groupBy("region_id", "_s").cogroup(usable.groupBy("region_id", "_s")).applyInPandas(one, schema)


class GroupMedian:
    """The median of a column, as a :class:`MergeableModel`: the state counts the values met."""

    def __init__(self, column: str):
        self.column = column

    def init(self) -> dict[float, int]:
        return {}

    def update(self, state: dict[float, int], rows: pd.DataFrame) -> dict[float, int]:
        return self.merge(state, rows[self.column].dropna().value_counts().to_dict())

    def merge(self, a: dict[float, int], b: dict[float, int]) -> dict[float, int]:
        for value, n in b.items():
            a[value] = a.get(value, 0) + n
        return a

    def finish(self, state: dict[float, int]) -> float:
        values = np.array(sorted(state), float)
        ends = np.cumsum([state[v] for v in values.tolist()])
        at = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], "right")
        return float(values[at].mean())


# --- blending -----------------------------------------------------------------------------

def blend_weights(distances: DataFrame, models: DataFrame, id: str, smooth) -> DataFrame:
    """(id, region_id, dist_km, w) for the regions that take part in a row's prediction.

    Only regions with a model count. Where even the nearest of them is no nearer
    than its smoothing width, it counts as containing the row. The weight falls
    from 1 inside to 0 at the smoothing width.
    """
    known = models.where(F.col("error").isNull()).select("region_id")
    d = distances.join(known, "region_id", "left_semi").withColumn("_s", _per_region(smooth))
    closest = d.groupBy(F.col(id).alias("_id")).agg(F.min("dist_km").alias("_min"))
    d = d.join(closest, F.col(id) == F.col("_id")).drop("_id")
    reset = (F.col("dist_km") >= F.col("_s")) & (F.col("dist_km") == F.col("_min"))
    d = d.withColumn("_d", F.when(reset, 0.0).otherwise(F.col("dist_km"))).where(F.col("_d") < F.col("_s"))
    share = (F.col("_s") - F.col("_d")) / F.col("_s")
    return d.select(id, "region_id", F.col("_d").alias("dist_km"), (share * share).alias("w"))


def blend(predictions: DataFrame, id: str) -> DataFrame:
    """Weighted mean of the non-null predictions (columns pred, w) per row."""
    used = predictions.where(F.col("pred").isNotNull())
    return used.groupBy(id).agg((F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("prediction"))


def predict_linear(data: DataFrame, distances: DataFrame, models: DataFrame, id: str, x, smooth) -> DataFrame:
    """(id, prediction) for every row that has a region with a model."""
    weights = blend_weights(distances, models, id, smooth)
    coef = models.where(F.col("coef").isNotNull()).select("region_id", "coef")
    scored = weights.join(coef, "region_id").join(data.select(id, *x), id)
    return blend(scored.withColumn("pred", linear_prediction(list(x))), id)


def predict_function(data: DataFrame, distances: DataFrame, models: DataFrame, id: str, predict, smooth) -> DataFrame:
    weights = blend_weights(distances, models, id, smooth)
    rows = weights.select(id, "region_id").join(data, id)
    preds = function_predictions(rows, models, id, predict)
    return blend(preds.join(weights.select(id, "region_id", "w"), [id, "region_id"]), id)


# --- both steps together ------------------------------------------------------------------

@dataclass
class RegionalModel:
    """Models of all regions and what predicting with them needs."""

    models: DataFrame
    members: DataFrame
    edges: DataFrame
    lon: str
    lat: str
    x: list[str] | None = None
    predict_function: Callable | None = None

    def predict(self, data: DataFrame, id: str, smooth, distances: DataFrame | None = None) -> DataFrame:
        """(id, prediction); ``smooth`` is a width in km, or one per region."""
        check_names(smooth, self.edges, "smooth", self.models.where(F.col("error").isNull()))
        if distances is None:
            widest = max(smooth.values()) if isinstance(smooth, dict) else smooth
            known = self.models.where(F.col("error").isNull()).select("region_id")
            edges = self.edges.join(known, "region_id", "left_semi")
            distances = cut_lineage(spatial.regional_distance(data, edges, id, self.lon, self.lat, widest))
        if self.x is not None:
            return predict_linear(data, distances, self.models, id, self.x, smooth)
        return predict_function(data, distances, self.models, id, self.predict_function, smooth)


def regional_model(data: DataFrame, edges: DataFrame, id: str, buffer, min_n: int = 0, y: str | None = None,
                   x=None, fit: Callable | MergeableModel | None = None, predict: Callable | None = None,
                   lon: str = "LONGITUDE", lat: str = "LATITUDE",
                   distances: DataFrame | None = None) -> RegionalModel:
    """Train one model per region: linear (``y``, ``x``) or the user's (``fit``, ``predict``).

    ``members`` of the result lists the training rows of each region, and the
    ``error`` column of ``models`` the regions whose model failed.
    """
    if (fit is None) == (y is None):
        raise ValueError("give either y and x, or fit and predict")
    check_names(buffer, edges, "buffer")
    if distances is None:
        members = training_rows(data, edges, id, buffer, min_n, lon, lat)
    else:
        members = cut_lineage(membership(distances, id, buffer, min_n))
    if fit is None:
        models = linear_models(data, members, id, y, list(x or []))
    else:
        models = (mergeable_models if hasattr(fit, "merge") else function_models)(data, members, id, fit)
    return RegionalModel(cut_lineage(models), members, edges, lon, lat,
                         None if fit else list(x or []), predict)
