import math

import numpy as np
import pytest

from lociframe.functions import specfun
from lociframe.operators import liability, linalg


@pytest.fixture(scope="module")
def data():
    """150 samples in families: an ordered trait of three levels and a linear one; variant 0 acts on both, 1 on the ordered one."""
    rng = np.random.default_rng(5)
    n = 150
    family = np.repeat(np.arange(n // 3), 3)
    k = 0.5 * np.eye(n) + 0.5 * (family[:, None] == family[None])
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    vg, ve = np.array([[0.5, 0.2], [0.2, 0.4]]), np.array([[1.0, 0.4], [0.4, 0.8]])
    g = rng.binomial(2, 0.4, (n, 10)).astype(float)
    l = 0.4 * x[:, [1]] + np.linalg.cholesky(k) @ rng.normal(size=(n, 2)) @ np.linalg.cholesky(vg).T + rng.normal(size=(n, 2)) @ np.linalg.cholesky(ve).T
    l[:, 0] += 0.9 * g[:, 0] + 0.8 * g[:, 1]
    l[:, 1] += 0.8 * g[:, 0]
    return rng, k, x, g, np.column_stack([np.digitize(l[:, 0], [0.8, 2.2]), l[:, 1]]).astype(float), vg, ve


@pytest.mark.parametrize("size", [1, 2, 3])
def test_moments_within_limits(size):
    rng = np.random.default_rng(size)
    cov = np.eye(size) + 0.4
    mean = rng.normal(size=(4, size))
    low, high = mean + rng.normal(-1, 1, (4, size)), np.full((4, size), np.inf)
    high[0] = low[0] + 0.7
    low[3] = -np.inf
    found = liability.block_moments(mean, cov, low, high)
    for i in range(4):
        m, c, p = linalg.truncated_normal(mean[i], cov, low[i], high[i], 1 << 15)
        assert np.allclose(found[0][i], m, atol=5e-3) and np.allclose(found[1][i], c, atol=2e-2) and math.exp(found[2][i]) == pytest.approx(p, rel=5e-3)
    whole = liability.block_moments(mean, cov, np.full((4, size), -np.inf), np.full((4, size), np.inf))
    assert np.allclose(whole[0], mean, atol=1e-8) and np.allclose(whole[1], cov, atol=1e-8) and np.allclose(whole[2], 0, atol=1e-8)


def test_unseen_values_are_expected_ones(data):
    _, _, _, _, y, _, ve = data
    part = y[:3].copy()
    part[0, 1], part[1, 0], part[2] = np.nan, np.nan, np.nan
    mean = np.full((3, 2), 0.3)
    e, c, p = liability.moments(part, [0], (np.array([0.8, 2.2]),), mean, ve)
    assert e[0, 1] == pytest.approx(0.3 + 0.4 * (e[0, 0] - 0.3)) and c[0, 1, 1] == pytest.approx(0.8 - 0.16 + 0.16 * c[0, 0, 0])
    assert e[1, 0] == pytest.approx(0.3 + 0.5 * (part[1, 1] - 0.3)) and c[1, 0, 0] == pytest.approx(1 - 0.2)
    assert np.allclose(e[2], 0.3) and np.allclose(c[2], ve) and p[2] == pytest.approx(0)


def test_mode(data):
    """The mode's scores are those that the random effects come from, and no move of the effects raises the objective."""
    rng, k, x, _, y, vg, ve = data
    y = y.copy()
    y[:5, 1], y[5:9, 0], y[9] = np.nan, np.nan, np.nan
    one = liability.fit(y, x, k, list(range(150)), [0], vg, ve)
    assert one.settled and np.abs(one.inner.residual @ x).max() < 1e-6

    def objective(beta, r):
        u = vg @ r @ k
        return liability.moments(y, [0], one.thresholds, x @ beta + u.T, ve)[2].sum() - 0.5 * (r * u).sum()

    assert objective(one.beta, one.inner.residual) == pytest.approx(one.objective, abs=1e-6)
    for _ in range(5):
        assert objective(one.beta + 0.01 * rng.normal(size=one.beta.shape), one.inner.residual + 0.01 * rng.normal(size=(2, 150))) < one.objective


def test_independent_traits(data):
    """Without covariances: the linear trait is a regression of known variance, the binary one a probit score test by observed information."""
    _, k, _, g, y, _, _ = data
    b, n = (y[:, 0] > 0).astype(float), len(y)
    one = liability.fit(np.column_stack([b, y[:, 1]]), np.ones((n, 1)), k, list(range(n)), [0], np.zeros((2, 2)), np.diag([1.0, 2.0]), [np.array([0.0])])
    found = liability.score(g, one)
    mu = float(specfun.norm_ppf(np.array([b.mean()]))[0])
    density = math.exp(-mu * mu / 2) / math.sqrt(2 * math.pi)
    s = np.where(b > 0, density / b.mean(), -density / (1 - b.mean()))
    w = s * (s + mu)
    centred = g - g.mean(axis=0)
    want = (s @ g) ** 2 / (w @ g**2 - (w @ g) ** 2 / w.sum()), (centred.T @ y[:, 1]) ** 2 / (centred**2).sum(axis=0) / 2
    assert one.beta[0, 0] == pytest.approx(mu, abs=1e-6)
    assert np.allclose(found["stat_d0"], want[0], rtol=1e-5) and np.allclose(found["stat_d1"], want[1], rtol=1e-6) and np.allclose(found["stat"], sum(want), rtol=1e-5)


def test_scan(spark, data):
    rng, k, x, g, y, vg, ve = data
    one = liability.fit(y, x, k, list(range(150)), [0])
    assert one.ve[0, 0] == pytest.approx(1) and one.ve[0, 1] > 0
    want = liability.score(g, one)
    assert want["p"][0] < 1e-8 and want["p_d0"][0] < 1e-2 and want["p_d1"][0] < 1e-2 and want["p_d0"][1] < 1e-4 and want["beta_d0"][0] > 0.4
    null = liability.score(rng.binomial(2, 0.3, (150, 800)).astype(float), one)
    assert 1.6 < null["stat"].mean() < 2.4 and (null["p"] < 0.05).mean() < 0.09
    cells = spark.createDataFrame([(j, i, float(g[i, j])) for i in range(150) for j in range(3)] + [(9, i, 1.0) for i in range(150)], "v_idx long, s_idx long, dosage double")
    rows = {r["v_idx"]: r for r in liability.scan(cells, one).collect()}
    assert all(rows[j][name] == pytest.approx(want[name][j], rel=1e-6) for j in range(3) for name in want) and np.isnan(rows[9]["p"])
    with pytest.raises(ValueError):
        liability.fit(y + 0.5, x, k, list(range(150)), [0], vg, ve)
    with pytest.raises(ValueError):
        liability.fit(y, x, k, list(range(150)), [0], vg, ve, [np.array([0.0])])
