"""Fits and tables of many samples: what the driver and the tasks hold, and the same results as without these limits."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__
from lociframe.operators import env_curves, thin
from lociframe.operators.env_curves import Basis

RNG = np.random.default_rng(11)
N = 70
X = np.column_stack([np.ones(N), RNG.standard_normal(N)])
KERNELS = [thin.Thin(RNG.standard_normal((N, m)) / np.sqrt(m)) for m in (8, 6, 5)]
CURVES = RNG.standard_normal((N, 6)) + np.hstack([KERNELS[0].factor @ RNG.standard_normal((8, 3)), KERNELS[1].factor @ RNG.standard_normal((6, 3))])


@pytest.mark.parametrize("count", [2, 3])
def test_curves_of_complete_samples_need_few_and_small_steps(monkeypatch, count):
    sizes, inv = [], np.linalg.inv
    monkeypatch.setattr(env_curves.np.linalg, "inv", lambda m: sizes.append(len(m)) or inv(m))
    basis = Basis("legendre", 0.0, 1.0, 1)
    a = env_curves.fit(CURVES, X, KERNELS[:count], list(range(N)), list("abc"), basis)
    widths = [k.factor.shape[1] for k in KERNELS[:count]]
    assert max(sizes) == 6 * sum(widths[1:])
    monkeypatch.undo()
    b = env_curves.fit(CURVES, X, [k.dense() for k in KERNELS[:count]], list(range(N)), list("abc"), basis)
    assert a.settled and a.log_likelihood > b.log_likelihood - 1e-4
    if count == 2:
        assert np.isclose(a.log_likelihood, b.log_likelihood, atol=1e-4) and np.allclose(a.residual, b.residual, atol=1e-3)
        assert all(np.allclose(p, q, atol=5e-3) for p, q in zip(a.covariances, b.covariances, strict=True))


def test_derivatives_of_complete_samples():
    at = env_curves._complete(CURVES, X, [k.factor for k in KERNELS])
    draw = [RNG.standard_normal((6, 8)) for _ in range(4)]
    covs = [w @ w.T / 8 for w in draw]
    _, slopes = at(covs)
    v = np.kron(covs[-1], np.eye(N)) + sum(np.kron(c, k.dense()) for c, k in zip(covs, KERNELS, strict=False))
    x, y, inverse = np.kron(np.eye(6), X), CURVES.T.ravel(), np.linalg.inv(v)
    gram = x.T @ inverse @ x
    p = inverse - inverse @ x @ np.linalg.solve(gram, x.T @ inverse)
    assert np.isclose(at(covs)[0], 0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(gram)[1] + y @ p @ y))
    m = (p - np.outer(p @ y, p @ y)).reshape(6, N, 6, N)
    for found, k in zip(slopes, [*(k.dense() for k in KERNELS), np.eye(N)], strict=True):
        assert np.allclose(found, np.einsum("aibj,ij->ab", m, k))


def _plain_copying(g: np.ndarray, switch: float = 0.05, error: float = 0.02) -> np.ndarray:
    """Each sample by itself against each other one."""
    n, m = g.shape
    out, mean = g.copy(), np.nanmean(g, axis=0)
    for s in np.flatnonzero(np.isnan(g).any(axis=1)):
        ref = np.delete(g, s, axis=0)
        ref = np.where(np.isnan(ref), mean, ref)
        emit = np.where(np.isnan(g[s]), 1.0, ((1 - error) / error) ** (-np.abs(ref - np.nan_to_num(g[s])) / 2))
        move = (1 - switch) * np.eye(n - 1) + switch / (n - 1)
        for t in np.flatnonzero(np.isnan(g[s])):
            left, right = emit[:, 0], np.ones(n - 1)
            for k in range(1, t + 1):
                left = (move @ left) * emit[:, k]
            for k in range(m - 2, t - 1, -1):
                right = move @ (emit[:, k + 1] * right)
            out[s, t] = (left * right * ref[:, t]).sum() / (left * right).sum()
    return out


@pytest.mark.parametrize("held", [1, 4_000_000])
def test_copying_takes_equal_samples_as_one_state(monkeypatch, held):
    from lociframe.operators import genetics_extra

    g = RNG.integers(0, 3, (9, 6)).astype(float)
    g[RNG.random(g.shape) < 0.2] = np.nan
    g = np.vstack([g, g, g[:4]])
    monkeypatch.setattr(genetics_extra, "COPIED", held)
    assert np.allclose(genetics_extra.copying_posterior(g), _plain_copying(g))
    large = np.tile(g, (2000, 1))
    found = genetics_extra.copying_posterior(large)  # 40,000 samples, 9 states
    assert not np.isnan(found).any() and np.array_equal(found[: len(g)], found[-len(g) :])


def test_copying_of_one_sample():
    from lociframe.operators import genetics_extra

    assert np.array_equal(genetics_extra.copying_posterior(np.array([[1.0, np.nan, 2.0]])), [[1.0, 0.0, 2.0]])


def test_independent_curves_hold_no_matrix_of_samples():
    n = 30_000
    x = np.column_stack([np.ones(n), RNG.standard_normal(n)])
    y = RNG.standard_normal((n, 6)) + 36
    fit = env_curves.independent(y, x, list(range(n)), list("abc"), Basis("legendre", 0.0, 1.0, 1))
    assert fit.inner.vectors.shape[1] <= 8
    g = RNG.integers(0, 3, (n, 3)).astype(float)
    beta, cov = env_curves._effects(g, fit)
    left = lambda v: v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    gl, yl = left(g), left(y)
    assert np.allclose(beta, gl.T @ yl / (gl**2).sum(axis=0)[:, None], atol=1e-8)
    assert np.allclose(np.diagonal(cov, axis1=1, axis2=2), (yl**2).sum(axis=0) / (n - 2) / (gl**2).sum(axis=0)[:, None], rtol=1e-6)


def test_leave_one_out_by_factors(spark):
    from lociframe.operators import kinship

    rows = [(v, s * 3, float(RNG.integers(0, 3)), v % 3) for v in range(7) for s in range(12) if (v + s) % 7]
    cells = spark.createDataFrame(rows, "v_idx long, s_idx long, dosage double, chr int")
    ids = [s * 3 for s in range(12)]
    whole = kinship.leave_one_out(cells, ids)
    found = dict(thin.leave_one_out(cells, ids))
    assert list(found) == sorted(whole) and all(isinstance(k, thin.Thin) and np.allclose(k.dense(), whole[c]) for c, k in found.items())
    odd = cells.unionByName(cells.limit(0).sparkSession.createDataFrame([(0, 0, 1.0, 2)], cells.schema))  # a variant on two chromosomes
    whole = kinship.leave_one_out(odd, ids)
    assert all(np.allclose(k, whole[c]) for c, k in thin.leave_one_out(odd, ids))


def test_spectrum_by_factors():
    from lociframe.operators import kinship

    k = KERNELS[0]
    values, vectors = thin.spectrum(k, 11)
    whole = kinship.spectrum(k.dense())
    assert len(values) == 11 and np.allclose(values, whole[0][:11]) and np.allclose(vectors.T @ vectors, np.eye(11))
    assert np.allclose(np.abs(vectors[:, :8].T @ whole[1][:, :8]), np.eye(8), atol=1e-8)


@pytest.mark.parametrize("name", ["pca", "lmm_scan_loco"])
def test_more_queries_need_no_full_matrix(spark, sf, monkeypatch, name):
    from lociframe.operators import kinship
    from lociframe.plans import views

    geno = views.geno
    monkeypatch.setattr(views, "geno", lambda spark, sf: geno(spark, sf).where("v_idx < 6"))
    monkeypatch.setattr(kinship, "MOST_SAMPLES", 5)
    assert __spark_entry__.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("held", [1 << 25, 1])
def test_relationships_by_groups_of_tiles(spark, monkeypatch, held):
    """Tiles of two samples: values go to few groups, not to each tile; the products are the same."""
    from lociframe.operators import kinship

    n = 75
    rows = [(v, s * 2, float(RNG.integers(0, 3)), 1.0) for v in (1, 3, 64, 65, 200) for s in range(n) if (v + s) % 9]
    cells = spark.createDataFrame(rows, "v_idx long, s_idx long, x double, norm double")
    whole = np.zeros((n, 5))
    for v, s, x, _ in rows:
        whole[s // 2, (1, 3, 64, 65, 200).index(v)] = x
    seen, grouped = [], kinship._grouped
    monkeypatch.setattr(kinship, "_grouped", lambda packed, group, *rest: seen.append(group) or grouped(packed, group, *rest))
    monkeypatch.setattr(kinship, "GROUPED", held)
    found = kinship.gram_pairs(cells, [s * 2 for s in range(n)], 2).toPandas()
    assert (seen[0] > 1) if held > 1 else not seen
    assert len(found) == n * (n + 1) // 2 and not found.duplicated(["i", "j"]).any() and (found["i"] <= found["j"]).all()
    assert np.allclose(found["k"], (whole @ whole.T)[found["i"] // 2, found["j"] // 2] / 5)


def test_stacked_forms_hold_some_samples_at_once(monkeypatch):
    n, k = 60, 3
    factor = RNG.integers(0, 3, (n, 7)) / 3.0
    weights = np.zeros((k, k, n))
    weights[range(k), range(k)] = RNG.random((k, n))
    weights[0, 1] = weights[1, 0] = 0.1
    design, g = X[:n], RNG.integers(0, 3, (n, 4)).astype(float)
    p = thin.solve(weights, np.zeros((k, n)), design, thin.Thin(factor), 0.4 * np.eye(k) + 0.1).projection
    v = np.kron(0.4 * np.eye(k) + 0.1, factor @ factor.T)
    w = np.block([[np.diag(weights[a, b]) for b in range(k)] for a in range(k)])
    inverse = np.linalg.inv(np.linalg.inv(w) + v)
    x = np.kron(np.eye(k), design)
    whole = (inverse - inverse @ x @ np.linalg.solve(x.T @ inverse @ x, x.T @ inverse)).reshape(k, n, k, n)
    want = np.einsum("im,aibj,jm->abm", g, whole, g)
    for rows in (7, 8192):
        monkeypatch.setattr(thin, "ROWS", rows)
        small = p.compact()
        assert small.nbytes < 7 * 256 * 8 + n * 7 + 1 and np.array_equal(small.factor[3:9], factor[3:9])
        assert np.allclose(p.forms(g), want) and np.allclose(small.forms(g), want)


def test_families_too_large_are_refused_before_their_pairs_are_held(spark, monkeypatch):
    from lociframe.operators import mixed

    rows = [(k, k, 1.0) for k in range(40)] + [(k, k + 1, 0.3) for k in range(0, 40, 2)]
    pairs = spark.createDataFrame(rows, "i long, j long, k double").coalesce(1)
    y, x = RNG.standard_normal(40), np.ones((40, 1))
    fit = mixed.fit_sparse(y, x, pairs, list(range(40)))
    assert sorted(len(a) for a, _ in fit.blocks) == [2] * 20
    read = []

    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            for r in rows + [(k, k + 1, 0.3) for k in range(39)]:
                read.append(r)
                yield r

    monkeypatch.setattr(mixed, "MOST_BYTES", 8 * 200)
    with pytest.raises(ValueError, match="families are too large"):
        mixed.fit_sparse(y, x, Rows(), list(range(40)))
    assert len(read) < 80
