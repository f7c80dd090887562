import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import env_glmm, glmm


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n, m = 160, 60
    family = np.repeat(np.arange(n // 4), 4)
    k = 0.5 * np.eye(n) + 0.5 * (family[:, None] == family[None])
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    chol = np.linalg.cholesky(np.array([[1.0, 0.6], [0.6, 1.0]]))
    u = np.linalg.cholesky(k) @ rng.normal(size=(n, 2)) @ chol.T
    g = rng.binomial(2, 0.4, (n, m)).astype(float)
    eta = 0.3 * x[:, [1]] + u + np.column_stack([1.3 * g[:, 0] + 1.2 * g[:, 1], 1.3 * g[:, 0] - 1.2 * g[:, 1]]) - 1.0
    y = (rng.random((n, 2)) < 1 / (1 + np.exp(-eta))).astype(float)
    return rng, x, k, g, y


def test_one_environment_is_the_single_model(data):
    _, x, k, g, y = data
    for family, trait in (("logit", y[:, 0]), ("probit", y[:, 0]), ("log", y.sum(axis=1))):
        one = glmm.fit(trait, x, k, list(range(160)), family)
        many = env_glmm.fit(trait[:, None], x, k, list(range(160)), family)
        assert many.settled and many.sigma[0, 0] == pytest.approx(one.tau, rel=0.02, abs=2e-3), family
        a, b = glmm.score(g, one), env_glmm.score(g, (many, np.inf))
        assert np.allclose(a["chi2"], b["chi2"], rtol=0.02, atol=1e-3) and np.allclose(a["beta"], b["alpha"], rtol=0.02, atol=1e-3)
    level = y.sum(axis=1)
    one = glmm.fit_ordinal(level.astype(int), x[:, 1:], k, list(range(160)), tau=0.5)
    many = env_glmm.fit(level[:, None], x[:, 1:], k, list(range(160)), "ordinal", sigma=np.array([[0.5]]))
    assert np.allclose(glmm.score(g, one)["chi2"], env_glmm.score(g, (many, np.inf))["chi2"], rtol=1e-3, atol=1e-4)


def test_independent_environments_with_unseen_samples(data):
    """A diagonal covariance: each environment is a model of its own on the samples that it saw."""
    _, x, k, g, y = data
    y = y.copy()
    y[:30, 0], y[100:, 1] = np.nan, np.nan
    many = env_glmm.fit(y, x, k, list(range(160)), sigma=np.diag([0.4, 0.9]))
    found = env_glmm.score(g, (many, np.inf))
    joint = 0
    for e, tau in enumerate((0.4, 0.9)):
        own = ~np.isnan(y[:, e])
        one = glmm.score(g[own], glmm.fit(y[own, e], x[own], k[np.ix_(own, own)], list(range(own.sum())), tau=tau))
        assert np.allclose(one["beta"], found[f"beta_e{e}"], rtol=1e-4, atol=1e-6) and np.allclose(one["p"], found[f"p_e{e}"], rtol=1e-3)
        joint = joint + one["chi2"]
    assert np.allclose(joint, found["chi2"], rtol=1e-4)


def test_covariance_is_stationary(data):
    """At the fit no small change of the covariance raises the likelihood of the working response."""
    _, x, k, _, y = data
    n = len(x)
    many = env_glmm.fit(y, x, k, list(range(n)), tol=1e-8)
    assert many.settled and np.linalg.eigvalsh(many.sigma)[0] >= -1e-9
    w = (many.mean * (1 - many.mean)).ravel()
    z = np.log(many.mean / (1 - many.mean)).ravel() + many.residual.ravel() / w
    full = np.kron(np.eye(2), x)

    def likelihood(sigma):
        v = np.diag(1 / w) + np.kron(sigma, k)
        i = np.linalg.inv(v)
        gram = full.T @ i @ full
        p = i - i @ full @ np.linalg.solve(gram, full.T @ i)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(gram)[1] + z @ p @ z)

    best = likelihood(many.sigma)
    for change in ([[1, 0], [0, 0]], [[0, 0], [0, 1]], [[0, 1], [1, 0]], [[1, 1], [1, 1]]):
        for size in (0.02, -0.02):
            new = many.sigma + size * np.array(change)
            if np.linalg.eigvalsh(new)[0] >= 0:
                assert likelihood(new) <= best + 1e-6


def test_effects_and_null(data):
    rng, x, k, g, y = data
    many = env_glmm.fit(y, x, k, list(range(160)))
    found = env_glmm.score(g, (many, 2.0))
    assert found["p_common"].argmin() == 0 and found["p_gxe"].argmin() == 1 and set(np.argsort(found["p"])[:2]) == {0, 1}
    assert max(found["p_common"][0], found["p_gxe"][1]) < 1e-3
    assert np.allclose(found["chi2"], (found["alpha"] / found["se"]) ** 2 + found["chi2_gxe"])
    c = np.array([[1.0, -1.0]])
    v = np.array([[[g[:, j] @ many.projection[a, :, b] @ g[:, j] for b in range(2)] for a in range(2)] for j in range(5)])
    for j in range(5):
        inverse = np.linalg.inv(v[j])
        d = c @ inverse @ (many.residual @ g[:, j])
        assert found["chi2_gxe"][j] == pytest.approx(float(d @ np.linalg.solve(c @ inverse @ c.T, d)), rel=1e-6)
    null = env_glmm.score(rng.binomial(2, 0.3, (160, 1500)).astype(float), (many, 2.0))
    for name in ("p", "p_common", "p_gxe", "p_e0", "p_e1"):
        assert 0.02 < (null[name] < 0.05).mean() < 0.085 and 0.42 < null[name].mean() < 0.58, name


def test_scan_in_spark(spark, data):
    _, x, k, g, y = data
    many = env_glmm.fit(y, x, k, list(range(160)))
    cells = spark.createDataFrame([(v, s, float(g[s, v])) for v in range(8) for s in range(160)] + [(8, s, 1.0) for s in range(160)], "v_idx long, s_idx long, dosage double")
    rows = {r["v_idx"]: r for r in env_glmm.scan(cells, many).collect()}
    want = env_glmm.score(g[:, :8], (many, 2.0))
    assert len(rows) == 9 and all(rows[v][name] == pytest.approx(want[name][v], rel=1e-9) for v in range(8) for name in want)
    assert np.isnan(rows[8]["p"]) and np.isnan(rows[8]["p_e0"])
    assert env_glmm.scan(cells.where(F.lit(False)), many).count() == 0
