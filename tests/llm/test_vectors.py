import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from firnline.llm import whitening

REAL = np.longdouble


def orthogonal(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(REAL)
    for _ in range(4):
        q = q @ (np.eye(n, dtype=REAL) * REAL(1.5) - REAL(0.5) * (q.T @ q))
    return q


@pytest.mark.parametrize("values", [np.linspace(1, 64, 64), np.r_[1 + np.arange(20) * 1e-9, np.linspace(7, 9, 40)], 10.0 ** -np.linspace(0, 9, 40),
                                    np.r_[np.ones(15), np.full(15, 2.0)], np.r_[np.zeros(20), np.linspace(1, 3, 20)], np.zeros(4), np.ones(1)])
def test_refined_reaches_extended_precision(values):
    q = orthogonal(len(values), 3)
    a = (q * values.astype(REAL)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.refined(a)
    size = max(1.0, float(np.abs(values).max()))
    assert np.abs(a @ x - x * got).max() < 1e-16 * size and np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    order = np.argsort(-values, kind="stable")
    assert np.abs(got - values[order]).max() < 1e-16 * size
    gaps = np.abs(values[:, None] - values[None, :]) + np.eye(len(values)) * 9
    if len(values) > 1 and gaps.min() > 1e-10:
        q = q[:, order]
        apart = np.abs(x * np.sign((q * x).sum(0)) - q).max(0)
        assert (apart < 1e-16 + 4e-18 * size / gaps[order][:, order].min(0)).all()
        # Double precision alone is not as good where values are close.
        if gaps.min() < 1e-8:
            plain = np.linalg.eigh(a.astype(np.float64))[1][:, ::-1]
            assert np.abs(plain * np.sign((q * plain).sum(0)) - q).max() > 100 * apart.max()


def test_whole_numbers():
    found = whitening.whole_numbers(pa.array([[0.5, -0.01], None, [1.0, None], [float("nan"), 1.0], [], [1.0], [float("inf"), 0.0], [3e7, 0.0], [-2.0, 2.0]],
                                             pa.list_(pa.float32())))
    assert {d: (at.tolist(), x.tolist()) for d, (at, x) in found.items()} == {2: ([0, 8], [[32, -1], [-128, 128]]), 1: ([5], [[64]])}


@pytest.mark.parametrize("top", [300, 1 << 29])
def test_products_are_exact(top):
    z = np.random.default_rng(top).integers(-top, top, (500, 7))
    a, b, c = whitening.products(z)
    want = z.astype(object).T @ z.astype(object)
    assert ((a.astype(object) << 32) + (b.astype(object) << 16) + c.astype(object) == want).all()


def exact_covariance(x):
    n, s = len(x), [sum(int(r[i]) for r in x) for i in range(len(x[0]))]
    d = [[int(v) * n - t for v, t in zip(r, s)] for r in x]
    return s, [[Fraction(sum(r[i] * r[j] for r in d), n ** 3) for j in range(len(s))] for i in range(len(s))]


def test_whitened(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(40, 40)) / 6
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate((r.normal(size=(300, 40)) @ mix).astype(np.float32))]
    odd = [(900, None), (901, []), (902, [1.0] * 39), (903, [float("nan")] + [0.0] * 39), (904, [None] + [0.0] * 39), (None, vectors[7][1]), (8, vectors[8][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, n int, `a.b` string").repartition(5)
    rows = whitening.whitened(df).collect()
    kept = vectors + odd[-2:]
    assert len(rows) == len(kept) * 32 and {x.n for x in rows} == {len(kept)}
    x = [[math.floor(64 * v) + 1_000_000 for v in row] for _, row in kept]
    s, cov = exact_covariance(x)
    n = len(x)
    model = whitening.fit(df)
    a = np.array([[whitening.extended(v.numerator, v.denominator) for v in row] for row in cov])
    values, basis = whitening.refined(a)
    assert np.abs(model.values - values[:32].astype(float)).max() <= 1e-15 * float(values[0])
    by = {}
    for q in rows:
        by.setdefault(q.vec_id, {}).setdefault(q.component, []).append(q)
    assert len(by[8][1]) == 2 and by[None][5][0].whitened == by[7][5][0].whitened
    for i, row in zip((0, 100, 299), (x[0], x[100], x[299])):
        want = np.array([float(Fraction(v * n - t, n)) for v, t in zip(row, s)]) @ model.basis / np.sqrt(model.values)
        got = by[i]
        assert got[1][0].deviation == sum((n * v - t) ** 2 for v, t in zip(row, s))
        assert np.allclose([got[k + 1][0].whitened for k in range(32)], want, rtol=1e-12, atol=1e-12)
    for k in range(32):
        assert abs(by[3][k + 1][0].explained - float(values[k] / np.trace(a))) < 1e-14
        c = model.basis[:, k].astype(REAL)
        assert np.abs(a @ c - c * values[k]).max() < 1e-14 * float(values[0]) and abs((c * c).sum() - 1) < 1e-14
    assert 0 <= rows[0].identity_error < 1e-11 and len({q.identity_error for q in rows}) == 1


def test_whitened_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(i, [0.25, 1.0, -1.0]) for i in range(3)], schema)).collect()
    assert len(same) == 9 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], schema)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and flat[0].identity_error < 1e-12
    assert max(r.explained for r in flat) == pytest.approx(1)
    huge = whitening.whitened(spark.createDataFrame([(i, [1e7 * (i % 2), 3.0 * i]) for i in range(3000)], schema)).collect()
    assert all(r.deviation is None for r in huge) and huge[0].identity_error < 1e-9
