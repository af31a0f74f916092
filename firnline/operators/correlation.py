"""Agreement of neighbouring stations.

A pair of stations has the days that both observed in common, which are many
times more rows than either has, and a station has thousands of neighbours. So
the days of a pair are never joined. Stations that lie together form blocks,
the days of a block are packed, and the sums of all pairs of two blocks are
matrix products over stations times days, taken for the parts of the blocks
that have a pair in the table. What is shuffled is a row for each pair and a
packed block for each block that it has pairs with.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.ranks import with_positions
from firnline.operators.reshape import distance_class
from firnline.session import cut_lineage

#: Stations of a block, of a part of it, and days that are unpacked at once.
BLOCK, PART, DAYS = 1024, 64, 1024
#: Added to the day of a row without a value.
NO_VALUE = 1 << 12
#: Share of the mean square below which a variance is taken from the deviations.
CANCELLED = 1e-6


def _together(places: DataFrame, lon: str, lat: str, elev: str) -> DataFrame:
    """(ID, _z) with neighbouring numbers for most neighbouring places: bits of the coordinates in turn."""
    names = [lon, lat, elev]
    one = places.groupBy("ID").agg(*[F.min(F.col(c).cast("double")).alias(c) for c in names])
    ends = one.agg(*[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).first()
    z = F.lit(0).cast("long")
    for k, c in enumerate(names):
        low, high = ends[f"min{c}"], ends[f"max{c}"]
        width = (high - low) if low is not None else 0.0
        cell = F.floor(F.least((F.col(c) - F.lit(low)) / F.lit(width or 1.0), F.lit(0.9999)) * 1024)
        cell = F.coalesce(cell, F.lit(0).cast("long"))
        for bit in range(10):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + 2 - k))
    return one.select("ID", z.alias("_z"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The days of a block as bytes: rows of each station, day and value, each in order of station and day."""
    i, d = rows["i"].to_numpy(), rows["d"].to_numpy()
    order = np.lexsort((d, i))
    i, d, v = i[order], d[order], np.nan_to_num(rows["v"].to_numpy(float)[order], nan=np.nan)
    head = np.bincount(i, minlength=BLOCK).astype("<u4").tobytes()
    wide = np.ascontiguousarray(v.astype("<f8").view(np.uint8).reshape(-1, 8).T).tobytes()
    data = zlib.compress(head + d.astype("<u2").tobytes() + wide, 1)
    return pd.DataFrame({"b": rows["b"].iloc[:1], "ELEMENT": rows["ELEMENT"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "data": [data]})


class _Days:
    """Sums by station and day of one packed block."""

    def __init__(self, data: bytes):
        raw = zlib.decompress(data)
        count = np.frombuffer(raw, "<u4", BLOCK)
        total, at = int(count.sum()), 4 * BLOCK
        day = np.frombuffer(raw, "<u2", total, at)
        v = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * total, at + 2 * total).reshape(8, -1).T).view("<f8").ravel()
        cell = np.repeat(np.arange(BLOCK), count) * DAYS + day % NO_VALUE
        there = day < NO_VALUE
        self.first, self.last = (int(f(day % NO_VALUE)) for f in (np.min, np.max))
        good = there & np.isfinite(v)

        shape = BLOCK // PART, PART, DAYS

        def by_cell(rows, weights):
            if single:
                out = np.zeros(BLOCK * DAYS)
                out[cell[rows]] = weights
            else:
                out = np.bincount(cell[rows], weights, BLOCK * DAYS)
            return out.reshape(shape)
        single = bool((np.diff(cell) > 0).all())
        every, plain = slice(None), bool(there.all())
        v2 = v if good.all() else v[good]
        kept = every if good.all() else good
        self.n = by_cell(every if plain else there, np.ones(total if plain else int(there.sum())))
        self.all = self.n if plain else by_cell(every, np.ones(total))
        self.s, self.q = by_cell(kept, v2), by_cell(kept, v2 * v2)
        self.ns = np.concatenate((self.n, self.s), axis=1)
        self.bad = None if v2.size == there.sum() else by_cell(there & ~good, np.ones(int((there & ~good).sum())))
        self.whole = bool((v2 == np.round(v2)).all()) and float(v2 @ v2) < 2 ** 40

    def flatten(self) -> None:
        """A row for each station; mean, scatter, least and greatest value of each day (a day has few rows)."""
        self.n, self.all, self.s, self.q = (t.reshape(BLOCK, DAYS) for t in (self.n, self.all, self.s, self.q))
        several = np.maximum(self.n, 1)
        self.mean = self.s / several
        self.within = np.where(self.n > 1, np.maximum(self.q - self.s * self.mean, 0), 0.0)
        self.low, self.high = self.mean, np.where(self.within <= 1e-12 * self.q, self.mean, np.inf)


def _sums(a: _Days, b: _Days, i: np.ndarray, j: np.ndarray, cuts: np.ndarray, with_all: bool) -> np.ndarray:
    """Sums over common days for the pairs (i, j), which are in order of parts that end at ``cuts``.

    Rows: all counts; counts, sums and products where both have a value; for
    each side count, sum and squares where that side has one; rows that are not finite.
    """
    out = np.zeros((11, len(i)))
    days = slice(max(a.first, b.first), min(a.last, b.last) + 1)
    a_ns, a_n, a_q, b_ns, b_n, b_q = (t[:, :, days] for o in (a, b) for t in (o.ns, o.n, o.q))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x, y = i[lo] // PART, j[lo] // PART
        r, c = i[lo:hi] - x * PART, j[lo:hi] - y * PART
        four = a_ns[x] @ b_ns[y].T
        nn, ns, sn, ss = four[r, c], four[r, c + PART], four[r + PART, c], four[r + PART, c + PART]
        out[1:5, lo:hi] = nn, sn, ns, ss
        if with_all:
            left = np.vstack((a.all[x], a.ns[x], a.q[x])) @ b.all[y].T
            right = a.all[x] @ np.vstack((b.ns[y], b.q[y])).T
            out[0, lo:hi] = left[r, c]
            for k in range(3):
                out[5 + k, lo:hi] = left[r + PART * (k + 1), c]
                out[8 + k, lo:hi] = right[r, c + PART * k]
        else:
            out[0, lo:hi] = out[5, lo:hi] = out[8, lo:hi] = nn
            out[6, lo:hi], out[9, lo:hi] = sn, ns
            out[7, lo:hi] = (a_q[x] @ b_n[y].T)[r, c]
            out[10, lo:hi] = (a_n[x] @ b_q[y].T)[r, c]
        for p, q in ((a.bad, b.all), (a.all, b.bad)):
            if p is not None and q is not None:
                out[1, lo:hi][(p[x] @ q[y].T)[r, c] > 0] = np.nan
    return out


def _deviations(days: list[tuple[bytes, bytes]], i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Covariance and variances of the pairs from deviations, days taken a second time; 0 where all values are equal."""
    mean = t[2] / t[1], t[3] / t[1]
    own = t[6] / t[5], t[9] / t[8]
    out = np.zeros((3, len(i)))
    low, high = np.full((2, len(i)), np.inf), np.full((2, len(i)), -np.inf)
    for left, right in days:
        a, b = _Days(left), _Days(right)
        for o in (a, b):
            o.flatten()
        for lo in range(0, len(i), 256):
            at = slice(lo, lo + 256)
            x, y = i[at], j[at]

            def moved(o, k, m):
                """Sums of deviations from ``m`` and of their squares by day."""
                m = m[at, None]
                gap = o.mean[k] - m
                return o.n[k] * gap, o.within[k] + o.n[k] * gap * gap
            out[0, at] += (moved(a, x, mean[0])[0] * moved(b, y, mean[1])[0]).sum(1)
            for side, (o, k, p, l) in enumerate(((a, x, b, y), (b, y, a, x))):
                out[1 + side, at] += (moved(o, k, own[side])[1] * p.all[l]).sum(1)
                met = (o.n[k] > 0) & (p.all[l] > 0)
                low[side, at] = np.minimum(low[side, at], np.where(met, o.low[k], np.inf).min(1))
                high[side, at] = np.maximum(high[side, at], np.where(met, o.high[k], -np.inf).max(1))
    for side in (0, 1):
        out[1 + side, low[side] == high[side]] = 0
    return np.array([out[0] / t[1], out[1] / t[5], out[2] / t[8]])


def _correlate(pairs: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``pairs`` with N and pcorr of each element, for the pairs of two blocks."""
    named = [c for c in pairs.columns if c not in ("g", "code")]
    empty = pd.DataFrame({c: pairs[c].iloc[:0] for c in ["g", "code", *named]}).assign(
        ELEMENT=pd.Series(dtype=object), N=pd.Series(dtype="int64"), pcorr=pd.Series(dtype=float))
    if not len(pairs) or not len(blobs):
        return empty
    met, back, times = np.unique(pairs["code"].to_numpy(), return_inverse=True, return_counts=True)
    place = met % (BLOCK * BLOCK)
    i, j = place // BLOCK, place % BLOCK
    order = np.lexsort((j // PART, i // PART))
    i, j = i[order], j[order]
    parts = i // PART * BLOCK + j // PART
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]))
    data = {(s, e, k): d for s, e, k, d in zip(blobs["side"], blobs["ELEMENT"], blobs["chunk"], blobs["data"])}
    found = []
    for element in sorted({e for _, e, _ in data}):
        days = [(data[0, element, k], data[1, element, k]) for s, e, k in sorted(x for x in data if x[:2] == (0, element)) if (1, element, k) in data]
        t, whole, cut = np.zeros((11, len(i))), True, False
        for left, right in days:
            a = _Days(left)
            b = a if left is right else _Days(right)
            t += _sums(a, b, i, j, cuts, a.all is not a.n or b.all is not b.n)
            whole &= a.whole and b.whole
            del a, b
        with np.errstate(all="ignore"):
            c = t[4] / t[1] - t[2] * t[3] / t[1] ** 2
            va, vb = (t[5] * t[7] - t[6] ** 2) / t[5] ** 2, (t[8] * t[10] - t[9] ** 2) / t[8] ** 2
            if not whole:
                near = np.flatnonzero((t[1] > 0) & ((va * t[5] <= CANCELLED * t[7]) | (vb * t[8] <= CANCELLED * t[10])))
                if len(near):
                    c[near], va[near], vb[near] = _deviations(days, i[near], j[near], t[:, near])
            both = np.sqrt(np.maximum(va, 0)) * np.sqrt(np.maximum(vb, 0))
            r = np.where(np.isnan(t[1]), np.nan, c / both)
        keep = np.isnan(t[1]) | ((t[1] > 0) & (both > 0))
        at = np.empty(len(order), dtype=int)
        at[order] = np.arange(len(order))
        row = at[back]
        mine = np.flatnonzero(keep[row])
        n = np.rint(t[0]).astype("int64")[row[mine]] * times[back[mine]]
        out = pairs.iloc[mine].reset_index(drop=True)
        found.append(out.assign(ELEMENT=element, N=n, pcorr=r[row[mine]]))
    return pd.concat(found, ignore_index=True)[["g", "code", *named, "ELEMENT", "N", "pcorr"]] if found else empty


def pair_correlation(pairs: DataFrame, obs: DataFrame, zero_free=("SNWD", "WESD"), places: DataFrame | None = None,
                     lon: str = "LONGITUDE", lat: str = "LATITUDE", elev: str = "ELEVATION") -> DataFrame:
    """N and Pearson correlation per pair and element over their common days.

    For the elements in ``zero_free`` both values have to be non-zero, which is
    applied before days are compared. Pairs without a correlation are left out.
    ``places`` has the coordinates of stations, so that those that lie together
    come into one block; without it blocks are drawn by hash, and more of them meet.
    """
    rows = obs.select("ID", "DATE", "ELEMENT", F.col("VALUE").cast("double").alias("VALUE")).where(
        ~F.col("ELEMENT").isin(*zero_free) | (F.col("VALUE") != 0)).where(
        F.col("ID").isNotNull() & F.col("DATE").isNotNull() & F.col("ELEMENT").isNotNull())
    # Correlation does not depend on where a station's values are counted from, and sums of small numbers lose less.
    base = F.coalesce(F.min(F.when(F.abs("VALUE") < float("inf"), F.col("VALUE"))), F.lit(0.0)).alias("_base")
    stations = rows.groupBy("ID").agg(base)
    if places is None:
        stations = stations.withColumn("_z", F.xxhash64("ID"))
    else:
        stations = stations.join(_together(places, lon, lat, elev), "ID", "left")
    at = F.col("_at")
    codes = cut_lineage(with_positions(stations, ["_z", "ID"], "_at").select(
        "ID", "_base", F.floor(at / BLOCK).cast("int").alias("b"), (at % BLOCK).cast("int").alias("i")))
    # A short row for each station. Pairs and observations would be shuffled once more for each join with it.
    day = F.datediff("DATE", F.lit("1970-01-01"))
    value = F.when(F.col("VALUE").isNull(), F.lit(0.0)).otherwise(F.col("VALUE") - F.col("_base"))
    numbered = rows.join(F.broadcast(codes), "ID").select(
        "b", "ELEMENT", F.floor(day / DAYS).cast("int").alias("chunk"), F.col("i").cast("short").alias("i"),
        (F.pmod(day, F.lit(DAYS)) + F.when(F.col("VALUE").isNull(), NO_VALUE).otherwise(0)).cast("short").alias("d"), value.alias("v"))
    packed = cut_lineage(numbered.groupBy("b", "ELEMENT", "chunk").applyInPandas(
        _pack, "b int, ELEMENT string, chunk int, data binary"))

    rest = [c for c in pairs.columns if c not in ("ID1", "ID2")]
    coded = pairs
    for k in ("1", "2"):
        coded = coded.join(F.broadcast(codes.select(F.col("ID").alias(f"ID{k}"), F.col("b").alias(f"_b{k}"), F.col("i").alias(f"_i{k}"))), f"ID{k}")
    swap = F.col("_b1") > F.col("_b2")

    def first(x, y) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x)).cast("long")
    g = F.shiftleft(first("_b1", "_b2"), 32).bitwiseOR(first("_b2", "_b1"))
    code = swap.cast("long") * (BLOCK * BLOCK) + first("_i1", "_i2") * BLOCK + first("_i2", "_i1")
    coded = coded.select(g.alias("g"), code.alias("code"), *rest)
    blocks = cut_lineage(coded.select("g").distinct())
    sides = blocks.select("g", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), b.cast("int").alias("b")) for s, b in (
        (0, F.shiftright("g", 32)), (1, F.col("g").bitwiseAND(F.lit((1 << 32) - 1))))])))
    copies = packed.join(sides, "b").select("g", "side", "ELEMENT", "chunk", "data")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    stats = coded.groupBy("g").cogroup(copies.groupBy("g")).applyInPandas(
        _correlate, f"{fields}, ELEMENT string, N long, pcorr double")
    swapped = F.col("code") >= BLOCK * BLOCK
    place = F.col("code") % (BLOCK * BLOCK)
    ends = (F.shiftright("g", 32), F.floor(place / BLOCK)), (F.col("g").bitwiseAND(F.lit((1 << 32) - 1)), place % BLOCK)
    for k in (0, 1):
        b, i = (F.when(swapped, ends[1 - k][n]).otherwise(ends[k][n]).cast("int").alias(c) for n, c in enumerate((f"_b{k}", f"_i{k}")))
        stats = stats.select("*", b, i)
    for k in (0, 1):
        names = codes.select(F.col("ID").alias(f"ID{k + 1}"), F.col("b").alias(f"_b{k}"), F.col("i").alias(f"_i{k}"))
        stats = stats.join(F.broadcast(names), [f"_b{k}", f"_i{k}"])
    # (What is not a number comes back from Python as null; other nulls are left out there.)
    return stats.select("ID1", "ID2", *rest, "ELEMENT", "N", F.coalesce("pcorr", F.lit(float("nan"))).alias("pcorr"))


def classed(study: DataFrame, min_n: int = 30) -> DataFrame:
    """Pairs with enough common days, with their distance class."""
    return (study.where(F.col("N") >= min_n).withColumn("distcut", distance_class(F.col("DIST")))
            .where(F.col("distcut").isNotNull()))
