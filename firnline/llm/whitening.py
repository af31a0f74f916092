"""Whitening of embeddings: float32 eigenvectors of the covariance, refined in higher precision (Ogita and Aishima 2018, 2019)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.text import col
from firnline.session import cut_lineage

#: Components that are returned at most.
COMPONENTS = 32
#: Steps of the refinement at most; it squares the error, so a few are enough.
STEPS = 30
# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Vectors with an entry of SCALE * |c| of this or more are dropped like those that are not finite: sums stay exact.
RANGE = 1 << 30
# Entries beyond this are multiplied in two halves of HALF bits.
_SMALL, _HALF = 1 << 20, 16

_GRAM = "i int, a array<long>, b array<long>, c array<long>"


def whole_numbers(vectors: pa.Array, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vector: (row numbers, floor(SCALE * c)) of the vectors without null, infinite or excessive entries."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()  # without what stands behind null vectors
    holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(sizes) - sizes
    found = {}
    for d in np.unique(sizes).tolist() if dim is None else [dim]:
        if not d:
            continue
        rows = np.flatnonzero(sizes == d)
        if d * len(rows) == len(values):
            c, gaps = values.reshape(-1, d), None if holes is None else holes.reshape(-1, d)
        else:
            at = starts[rows][:, None] + np.arange(d)
            c, gaps = values[at], None if holes is None else holes[at]
        with np.errstate(invalid="ignore"):
            ok = (np.abs(c) < RANGE / SCALE).all(1)  # false for NaN and infinity
        if gaps is not None:
            ok &= ~gaps.any(1)
        found[d] = rows[ok], np.floor(c[ok] * SCALE).astype(np.int64)
    return found


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length: the number of vectors (place -1) and the sum of each dimension."""
    total: dict[int, np.ndarray] = {}
    for part in parts:
        for d, (_, x) in whole_numbers(part.column("v")).items():
            now = total.setdefault(d, np.zeros(d + 1, np.int64))
            now[0] += len(x)
            now[1:] += x.sum(0)
    for d, now in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(now)], ["d", "i", "s"])


def products(z: np.ndarray) -> list[np.ndarray]:
    """Three whole-number matrices of z'z, to be taken times 2^32, 2^16 and 1: floating products whose sums are exact."""
    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((x.shape[1], y.shape[1]), np.int64)
        top = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(y).max(initial=0)))
        step = max(1, (1 << 53) // top)
        for k in range(0, len(x), step):
            out += (x[k:k + step].astype(np.float64).T @ y[k:k + step].astype(np.float64)).astype(np.int64)
        return out
    if np.abs(z).max(initial=0) <= _SMALL:
        one = exact(z, z)
        return [np.zeros_like(one), np.zeros_like(one), one]
    high, low = z >> _HALF, z & ((1 << _HALF) - 1)
    cross = exact(high, low)
    return [exact(high, high), cross + cross.T, exact(low, low)]


def _products(dim: int, centre: np.ndarray):
    """Per task: rows of the sum of products of the centred vectors."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((dim, dim), np.int64) for _ in range(3)]
        some = False
        for part in parts:
            _, x = whole_numbers(part.column("v"), dim)[dim]
            if len(x):
                some = True
                for t, p in zip(total, products(x - centre)):
                    t += p
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), *(pa.array(list(t), pa.list_(pa.int64())) for t in total)],
                                             ["i", "a", "b", "c"])
    return run


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each place; those of a place are in one partition, one for each task that read vectors."""
    total: dict[int, list[np.ndarray]] = {}
    for part in parts:
        for k, i in enumerate(part.column("i").to_pylist()):
            rows = [part.column(n)[k].values.to_numpy(zero_copy_only=False) for n in "abc"]
            total[i] = [x + y for x, y in zip(total[i], rows)] if i in total else [x.copy() for x in rows]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([t[n] for t in total.values()], pa.list_(pa.int64())) for n in range(3))],
                                         ["i", "a", "b", "c"])


def extended(numerator: int, denominator: int) -> np.longdouble:
    """A fraction of whole numbers to extended precision."""
    high = numerator / denominator
    p, q = high.as_integer_ratio()
    return np.longdouble(high) + np.longdouble((numerator * q - p * denominator) / (denominator * q))


def _even(m: np.ndarray) -> np.ndarray:
    """Without the asymmetry of rounding, which small gaps would magnify."""
    return (m + m.T) / 2


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Groups of places whose values follow each other at distances of ``least`` or less."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > least) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, in the precision of ``matrix``, by falling value.

    Starts from eigenvectors in float32. Each step corrects them by matrix
    products alone: with R = I - X'X and S = X'AX, X goes to X + XE, where
    E = (S + R diag(l)) / (l_j - l_i), and R / 2 where two values are closer
    than the error of the step can tell. Such clusters are first turned by the
    eigenvectors of their own small matrix X_J'(A - m)X_J, m the cluster's
    mean, in which their distances are no longer small against the entries.
    """
    n, real = len(matrix), matrix.dtype.type
    size = np.abs(matrix).max(initial=real(0))
    if not size:
        return np.zeros(n, matrix.dtype), np.eye(n, dtype=matrix.dtype)
    a = matrix / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(matrix.dtype)
    one, bound = np.eye(n, dtype=matrix.dtype), np.sqrt((a * a).sum())
    best = None
    for _ in range(STEPS):
        r = _even(one - x.T @ x)
        s = _even(x.T @ (a @ x))
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(np.diag(s))
        error = np.sqrt((rest * rest).sum()) + np.sqrt((r * r).sum())
        if best is None or error < best[0]:
            worse = 0
            best = error, values, x
        else:
            worse += 1
        if worse == 3 or error <= n * np.finfo(matrix.dtype).eps / 4:
            break
        close = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + bound * np.sqrt((r * r).sum()))
        groups = _clusters(values, close)
        if groups:
            x = x + x @ (r / 2)  # orthonormal first, so that the small matrices are those of a basis
            for g in groups:
                part = x[:, g]
                middle = values[g].mean()
                small = part.T @ (a @ part - middle * part)
                scale = np.abs(small).max()
                if scale:
                    turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))[1]
                    x[:, g] = part @ turn.astype(matrix.dtype)
            r = _even(one - x.T @ x)
            s = _even(x.T @ (a @ x))
            values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        x = x + x @ np.where(apart, (s + r * values[None, :]) / np.where(apart, gap, 1), r / 2)
    _, values, x = best
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


@dataclass
class Whitening:
    """n vectors of ``dim`` entries; ``centre`` and ``over``: sums are n * centre + over. ``basis`` has a column for each component."""

    n: int
    dim: int
    centre: np.ndarray
    over: list[int]
    values: np.ndarray
    basis: np.ndarray
    trace: float

    def rows(self, x: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(exact deviations, whitened) of vectors of whole numbers; a deviation that a long cannot hold is null."""
        z = x - self.centre
        shares = np.array([r / self.n for r in self.over])
        scaled = np.divide(self.basis, np.sqrt(self.values), out=np.full(self.basis.shape, np.nan), where=self.values > 0)
        return self._deviations(z), (z - shares) @ scaled

    def _deviations(self, z: np.ndarray) -> pa.Array:
        over = np.array(self.over, np.float64)
        about = ((self.n * z.astype(np.float64) - over) ** 2).sum(1)
        fits = about < 9e18  # then every term fits, and so does n * z
        out = np.zeros(len(z), np.int64)
        t = self.n * z[fits] - np.array(self.over, np.int64)
        out[fits] = (t * t).sum(1)
        null = np.zeros(len(z), bool)
        for k in np.flatnonzero(~fits):
            exact = sum((self.n * int(v) - o) ** 2 for v, o in zip(z[k], self.over))
            null[k] = exact >= 1 << 63
            out[k] = 0 if null[k] else exact
        return pa.array(out, mask=null)


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of ``embeddings`` that have no null or non-finite entry; None if there are none.

    Sums and products are whole numbers, so the covariance is exact to the
    last step whatever the partitions are. The driver gets its rows, of which
    there are as many as dimensions. Vectors of another length than most
    (of equally many, the longest) are left out.
    """
    vectors = embeddings.select(col(embeddings, vector_col).alias("v")).where("v is not null")
    added = vectors.mapInArrow(_sums, "d int, i int, s long").groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    added = cut_lineage(added)
    counts = added.where("i = -1 and s > 0").orderBy(F.desc("s"), F.desc("d")).first()
    if counts is None:
        return None
    dim, n = counts.d, int(counts.s)
    sums = {r.i: int(r.s) for r in added.where((F.col("d") == dim) & (F.col("i") >= 0)).collect()}  # dim numbers
    centre = np.array([sums[i] // n for i in range(dim)], np.int64)
    over = [sums[i] - n * int(centre[i]) for i in range(dim)]
    rows = vectors.mapInArrow(_products(dim, centre), _GRAM).repartition("i").mapInArrow(_added, _GRAM)
    gram = {r.i: [(int(x) << 32) + (int(y) << 16) + int(z) for x, y, z in zip(r.a, r.b, r.c)] for r in rows.collect()}  # dim rows
    cov = np.zeros((dim, dim), np.longdouble)
    for i in range(dim):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = extended(n * gram[i][j] - over[i] * over[j], n * n)
    values, basis = refined(cov)
    trace = float(np.trace(cov))
    # What is left of a value that is zero is not told from zero.
    zero = 16 * dim * np.finfo(cov.dtype).eps * max(values[0], 0) if dim else 0
    values = np.where(values > zero, values, 0)[:components]
    basis = basis[:, :components]
    lead = basis[np.argmax(np.abs(basis), 0), np.arange(basis.shape[1])]
    return Whitening(n, dim, centre, over, values.astype(np.float64), (basis * np.sign(lead)).astype(np.float64), trace)


def _wide(model: Whitening):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, x = whole_numbers(part.column("v"), model.dim)[model.dim]
            deviations, white = model.rows(x)
            k = white.shape[1]
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(at)), deviations, lists], ["vec_id", "deviation", "white"])
    return run


def _moments(means: np.ndarray | None, k: int):
    """Per task: sums of the whitened columns, or of their products about ``means``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if means is None else k * k)
        for part in parts:
            w = part.column("white").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)[:, :k]
            total += w.sum(0) if means is None else ((w - means).T @ (w - means)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])
    return run


def _identity_error(wide: DataFrame, n: int, k: int) -> float | None:
    """Largest entry of the covariance of the first ``k`` whitened columns minus the identity."""
    def summed(means):
        rows = wide.select("white").mapInArrow(_moments(means, k), "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
        return np.array([r.s for r in rows.orderBy("i").collect()]) / n  # k or k * k numbers
    return float(np.abs(summed(summed(None)).reshape(k, k) - np.eye(k)).max()) if k else None


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Vectors that are null, empty or have a null, non-finite or excessive entry
    give no row, nor do those of another length than most. A component
    without variance has null ``whitened``, and no part in identity_error; if
    all vectors are equal, explained and identity_error are null. deviation
    is null where a long cannot hold it. Repeated rows and null ids count as
    rows of their own; other columns are ignored; an empty table stays empty.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(embeddings, vector_col, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = embeddings.select(col(embeddings, id_col).cast("long").alias("vec_id"), col(embeddings, vector_col).alias("v")).where("v is not null")
    wide = cut_lineage(rows.mapInArrow(_wide(model), "vec_id long, deviation long, white array<double>"))
    error = _identity_error(wide, model.n, int((model.values > 0).sum()))
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values])
    return wide.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
