"""Models without a relationship matrix against those with one."""

import numpy as np
import pytest

from lociframe.operators import kinship, matrix_free, mixed


def study(spark, n, m, seed, structure=0.0, missing=0.02):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 3, n)
    base = rng.uniform(0.15, 0.85, m)
    p = np.clip(base[None] + structure * rng.standard_normal((3, m))[group], 0.02, 0.98)
    d = rng.binomial(2, p).astype(float)
    effect = rng.standard_normal(m) * (rng.random(m) < 0.3)
    signal = (d - d.mean(0)) @ effect
    y = signal / signal.std() + rng.standard_normal(n)
    d[rng.random((n, m)) < missing] = np.nan
    rows = [(v, s, None if np.isnan(d[s, v]) else float(d[s, v])) for v in range(m) for s in range(n)]
    cells = spark.createDataFrame(rows, "v_idx long, s_idx long, dosage double").persist()
    return cells, y, np.column_stack([np.ones(n), rng.standard_normal(n)])


@pytest.fixture(scope="module")
def small(spark):
    cells, y, x = study(spark, 60, 150, 1)
    ids = list(range(60))
    return cells, y, x, ids, kinship.relationship(cells, ids), matrix_free.stored_calls(cells, ids)


def test_products(small):
    _, y, x, _, k, calls = small
    v = np.column_stack([y, x, np.random.default_rng(0).standard_normal((60, 20))])
    assert np.allclose(matrix_free.times(calls, v), k @ v, atol=1e-10)


def test_lanczos():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 25))
    k = a @ a.T / 25
    starts = np.column_stack([rng.standard_normal((40, 3)), np.zeros(40), a[:, 0]])
    run = matrix_free.lanczos(lambda v: k @ v, starts, 40)
    w, u = np.linalg.eigh(k)
    for f in (lambda d: 1 / (2 * d + 1), lambda d: np.log1p(3 * d)):
        whole = u @ (f(np.maximum(w, 0))[:, None] * u.T)
        assert np.allclose(run.applied(f), whole @ starts, atol=1e-8)
        assert np.allclose(run.quadratic(f), np.einsum("ij,ik,kj->j", starts, whole, starts), atol=1e-8)


def test_fit_is_that_of_the_full_matrix(small):
    """As many probes as samples: the determinant is exact, and so is the fit."""
    _, y, x, ids, k, calls = small
    want = mixed.fit_null(y, x, k, ids)
    got = matrix_free.fit_null(y, x, calls, probes=60, steps=60)
    assert got.residual < 1e-8
    assert np.allclose([got.ratio, got.sigma2_g, got.sigma2_e, got.log_likelihood], [want.ratio, want.sigma2_g, want.sigma2_e, want.log_likelihood], rtol=1e-5)
    assert np.allclose(got.py, want.py, atol=1e-6) and np.allclose(got.gram_inverse, want.gram_inverse, rtol=1e-5)


def test_random_probes_and_scan(spark):
    """Thirty probes: the variances within a few hundredths, and the scan that of the exact model."""
    n = 500
    cells, y, x = study(spark, n, 400, 3)
    ids = list(range(n))
    calls = matrix_free.stored_calls(cells, ids)
    want = mixed.fit_null(y, x, kinship.relationship(cells, ids), ids)
    got = matrix_free.fit_null(y, x, calls)
    assert got.residual < 1e-6 and abs(np.log(got.ratio / want.ratio)) < 0.15
    assert abs(got.log_likelihood - want.log_likelihood) < 3
    exact = mixed.scan(cells, want).toPandas().set_index("v_idx").sort_index()
    own = matrix_free.scan(calls, got).toPandas().set_index("v_idx").sort_index()
    assert len(own) == len(exact)
    a, b = (exact["beta"] / exact["se"]) ** 2, (own["beta"] / own["se"]) ** 2
    assert np.corrcoef(a, b)[0, 1] > 0.995 and abs(b.sum() / a.sum() - 1) < 0.05
    assert got.gamma_spread < 0.1 * got.gamma


def test_more_samples_than_variants_take_no_passes(spark, monkeypatch):
    """The fit in the axes is that of the recurrences over the samples, and no vectors of the samples come back pass by pass."""
    cells, y, x = study(spark, 150, 40, 7)
    calls = matrix_free.stored_calls(cells, list(range(150)))
    monkeypatch.setattr(matrix_free, "MOST_VARIANTS", 0)
    want = matrix_free.fit_null(y, x, calls, steps=12)
    monkeypatch.undo()
    monkeypatch.setattr(matrix_free, "times", None)
    monkeypatch.setattr(matrix_free.packed, "BATCH_CELLS", 2000)  # tiles of 50 samples
    got = matrix_free.fit_null(y, x, calls, steps=12)
    for name in ("ratio", "sigma2_g", "sigma2_e", "log_likelihood", "gamma", "gamma_spread"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-6)
    assert np.allclose(got.py, want.py, atol=1e-7) and np.allclose(got.gram_inverse, want.gram_inverse, rtol=1e-6)


def test_leading_axes(spark):
    n = 200
    cells, _, _ = study(spark, n, 300, 5, structure=0.2)
    ids = list(range(n))
    k = kinship.relationship(cells, ids)
    values, vectors = matrix_free.leading_axes(matrix_free.stored_calls(cells, ids), 4)
    w, u = np.linalg.eigh(k)
    assert np.allclose(values, w[::-1][:4], rtol=1e-6)
    assert np.allclose(np.abs((vectors[:, :2] * u[:, ::-1][:, :2]).sum(axis=0)), 1, atol=1e-5)
    assert np.allclose(k @ vectors[:, :2], vectors[:, :2] * values[:2], atol=1e-4)


def test_odd_calls(spark):
    """Variants without calls or variation add nothing; more axes than samples are all of them; more samples than a matrix may have are no matter."""
    rows = [(0, s, float(s % 3)) for s in range(5)] + [(1, s, None) for s in range(5)] + [(2, s, 2.0) for s in range(5)] + [(3, s, float(s // 2)) for s in range(5)]
    cells = spark.createDataFrame(rows, "v_idx long, s_idx long, dosage double")
    calls = matrix_free.stored_calls(cells, range(5))
    x = np.array([[s % 3, s // 2] for s in range(5)], float)
    p = x.mean(0) / 2
    k = (x - 2 * p) @ (x - 2 * p).T / (2 * p * (1 - p)).sum()
    values, vectors = matrix_free.leading_axes(calls, 9)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, k, atol=1e-8)
    fit = matrix_free.fit_null(np.array([1.0, 2, 0, 3, 1]), np.ones((5, 1)), calls)
    found = {r.v_idx: r.p for r in matrix_free.scan(calls, fit).collect()}
    assert set(found) == {0, 1, 2, 3} and np.isnan(found[1]) and np.isnan(found[2]) and 0 <= found[0] <= 1
