"""Fits of variance components and mixed models against plain algebra, each other, and their limits."""

import math

import numpy as np
import pytest

from lociframe.functions import specfun
from lociframe.operators import glm, glmm, hypotheses, kinship, linalg, mediation, mixed, multitrait, pgs, reml


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 120
    z = rng.binomial(2, 0.4, (n, 300)).astype(float)
    z -= z.mean(axis=0)
    k = z @ z.T / (300 * 0.48)
    values, vectors = mixed.eigen(k)
    g = vectors @ (np.sqrt(values) * rng.standard_normal(n))
    x = np.column_stack([np.ones(n), rng.standard_normal(n)])
    return {"k": k, "values": values, "vectors": vectors, "g": g, "x": x, "y": 1 + 0.7 * g + rng.standard_normal(n), "m": rng.binomial(2, 0.3, (n, 6)).astype(float), "rng": rng, "ids": list(range(n))}


def rotated(d):
    return d["vectors"].T @ d["y"], d["vectors"].T @ d["x"], d["values"]


def test_reml_optimisers_agree(data):
    y, x, values = rotated(data)
    best = max(reml.log_likelihood(r, y, x, values) for r in np.exp(np.linspace(-8, 8, 2000)))
    for fit in (reml.newton, reml.fisher_scoring, reml.emma, reml.fit):
        found = fit(y, x, values)
        assert found.log_likelihood == pytest.approx(best, abs=1e-4) and found.converged, fit.__name__
    assert reml.expectation_maximisation(y, x, values, rounds=3000).log_likelihood == pytest.approx(best, abs=1e-3)
    s, ll, _ = reml.average_information(data["y"], data["x"], [data["k"]])
    # the dense form leaves out the determinant of x'x, which the rotation keeps
    assert ll == pytest.approx(best, abs=1e-3) and s[0] / s[1] == pytest.approx(reml.newton(y, x, values).ratio, rel=0.02)


def test_reml_by_definition(data):
    y, x, values = rotated(data)
    ratio, n, c = 0.8, len(y), 2
    h = ratio * data["k"] + np.eye(n)
    hi = np.linalg.inv(h)
    p = hi - hi @ data["x"] @ np.linalg.inv(data["x"].T @ hi @ data["x"]) @ data["x"].T @ hi
    s2 = data["y"] @ p @ data["y"] / (n - c)
    want = -0.5 * ((n - c) * math.log(2 * math.pi * s2) + np.linalg.slogdet(h)[1] + np.linalg.slogdet(data["x"].T @ hi @ data["x"])[1] + n - c)
    assert reml.log_likelihood(ratio, y, x, values) == pytest.approx(want)
    step = 1e-4
    f = [reml.log_likelihood(ratio + d, y, x, values) for d in (-step, 0, step)]
    assert reml.derivatives(ratio, y, x, values) == pytest.approx(((f[2] - f[0]) / 2 / step, (f[2] - 2 * f[1] + f[0]) / step**2), rel=1e-3)
    b, g = mixed.fit_eigen(data["y"], data["x"], data["values"], data["vectors"], data["ids"], ratio), data["m"]
    beta, se, _ = mixed.score(b, g)
    info = np.einsum("im,ij,jm->m", g, p, g)
    assert beta == pytest.approx(g.T @ p @ data["y"] / info)
    assert (beta / se) ** 2 == pytest.approx(beta**2 * info * (n - c - 1) / (s2 * (n - c) - beta**2 * info))


def test_refit_and_rank(data):
    fit = mixed.fit_null(data["y"], data["x"], data["k"], data["ids"])
    own = mixed.refit(data["m"][:, :2], {"y": data["y"], "x": data["x"], "values": data["values"], "vectors": data["vectors"]})
    again = mixed.fit_null(data["y"], np.column_stack([data["x"], data["m"][:, 0]]), data["k"], data["ids"])
    assert own["ratio"][0] == pytest.approx(again.ratio, rel=1e-3)
    low = mixed.fit_eigen(data["y"], data["x"], data["values"][5:], data["vectors"][:, 5:], data["ids"], fit.ratio)
    assert mixed.score(low, data["m"])[0] == pytest.approx(mixed.score(fit, data["m"])[0], abs=0.05)
    with pytest.raises(ValueError, match="too large"):
        mixed.eigen(np.broadcast_to(0.0, (40_000, 40_000)))


def test_solvers(data):
    v = data["k"] + np.eye(120)
    x, rounds = reml.conjugate_gradient(lambda b: v @ b, data["y"], np.diag(v))
    assert np.allclose(x, np.linalg.solve(v, data["y"]), atol=1e-6) and rounds < 120
    assert reml.stochastic_trace(lambda b: v @ b, 120, 400) == pytest.approx(np.trace(v), rel=0.02)
    assert reml.stochastic_logdet(lambda b: v @ b, 120, 100) == pytest.approx(np.linalg.slogdet(v)[1], rel=0.03)
    found = reml.sparse_fit(data["y"], data["x"], lambda b: data["k"] @ b, np.diag(data["k"]), probes=60)
    assert found.ratio == pytest.approx(reml.newton(*rotated(data)).ratio, rel=0.6)
    fixed, rounds = reml.accelerated(lambda x: 0.9 * x + np.array([0.1, 0.2]), np.zeros(2))
    assert fixed == pytest.approx([1, 2]) and rounds < 10
    at, value, settled = reml.minimise(lambda x: (x[0] - 3) ** 2 + 10 * (x[1] + x[0]) ** 2, np.zeros(2))
    assert at == pytest.approx([3, -3], abs=1e-4) and value < 1e-6 and settled


def test_glmm_without_variance_is_glm(data):
    rng = np.random.default_rng(1)
    n, x, m, ids, k = 120, data["x"], data["m"], data["ids"], data["k"]
    y = (rng.random(n) < 1 / (1 + np.exp(-data["g"]))).astype(float)
    assert glmm.score(m, glmm.fit(y, x, k, ids, tau=0.0))["chi2"] == pytest.approx(glm.score_logistic(m, glm.fit_logistic(y, x), spa_above=1e9)["chi2"], rel=1e-6)
    level = np.digitize(data["y"], np.quantile(data["y"], [0.33, 0.66]))
    assert glmm.score(m, glmm.fit_ordinal(level, x[:, 1:], k, ids, tau=0.0))["chi2"] == pytest.approx(glm.score_ordinal(m, glm.fit_ordinal(level, x[:, 1:]))["chi2"], rel=1e-3, abs=1e-5)
    assert glmm.score_multinomial(m, glmm.fit_multinomial(level, x, k, ids, tau=0.0))["chi2"] == pytest.approx(glm.score_multinomial(m, glm.fit_multinomial(level, x))["chi2"], rel=1e-4)
    time, event = rng.exponential(1, n).round(1) + 0.1, (rng.random(n) < 0.8).astype(float)
    assert glmm.score(m, glmm.fit_survival(time, event, x[:, 1:], k, ids, tau=0.0))["chi2"] == pytest.approx(glm.score_cox(m, glm.fit_cox(time, event, x[:, 1:]))["chi2"], rel=1e-4)
    # the identity family is the linear mixed model
    fit = glmm.fit(data["y"], x, k, ids, "identity")
    plain = mixed.fit_null(data["y"], x, k, ids)
    assert glmm.score(m, fit)["beta"] == pytest.approx(mixed.score(plain, m)[0], rel=1e-3)


def test_glmm_null_is_calibrated(data):
    """Relatives share the outcome: the mixed model's tail is near nominal where plain regression's is not."""
    rng = np.random.default_rng(2)
    n = 200
    group = np.repeat(np.arange(20), 10)
    k = (group[:, None] == group[None]).astype(float)
    g = rng.binomial(2, 0.5, (20, 400))[group].astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-1.5 * rng.standard_normal(20)[group]))).astype(float)
    x = np.ones((n, 1))
    fit = glmm.fit(y, x, k, list(range(n)))
    assert fit.tau > 0.1
    share = lambda p: float(np.mean(p < 0.05))
    assert share(glmm.score(g, fit)["p"]) < 0.12 and share(glm.score_logistic(g, glm.fit_logistic(y, x))["p"]) > 0.2


def test_links():
    eta = np.linspace(-3, 3, 31)
    for name, f in glmm.FAMILIES.items():
        mu = f.mean(eta)
        assert f.link(mu) == pytest.approx(eta, abs=1e-6), name
        assert f.slope(eta) == pytest.approx((f.mean(eta + 1e-5) - f.mean(eta - 1e-5)) / 2e-5, rel=1e-4), name


def test_multitrait_by_definition(data):
    rng = np.random.default_rng(3)
    y = np.column_stack([data["y"], 0.5 * data["g"] + rng.standard_normal(120)])
    vg, ve = np.array([[1.0, 0.4], [0.4, 0.6]]), np.array([[0.8, 0.1], [0.1, 1.2]])
    fit = multitrait.null_fit(y, data["x"], data["values"], data["vectors"], data["ids"], vg, ve)
    v = np.kron(vg, data["k"]) + np.kron(ve, np.eye(120))
    x = np.kron(np.eye(2), data["x"])
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    g = np.kron(np.eye(2), data["m"][:, [0]])
    cov = np.linalg.inv(g.T @ p @ g)
    beta = cov @ g.T @ p @ y.T.ravel()
    found = multitrait.score(data["m"], fit)
    assert [found["beta_d0"][0], found["beta_d1"][0]] == pytest.approx(beta) and found["stat"][0] == pytest.approx(beta @ np.linalg.solve(cov, beta))
    n, c = data["x"].shape
    want = -0.5 * ((n - c) * 2 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ vi @ x)[1] + y.T.ravel() @ p @ y.T.ravel())
    assert fit.log_likelihood == pytest.approx(want)
    env = multitrait.score_environments(data["m"], fit)
    assert env["alpha"][0] == pytest.approx(beta.mean()) and env["se"][0] == pytest.approx(math.sqrt(cov.sum()) / 2)
    assert env["stat_gxe"][0] == pytest.approx((beta[0] - beta[1]) ** 2 / (cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]))


def test_multitrait_structures(data):
    rng = np.random.default_rng(4)
    y = np.column_stack([data["y"], 0.5 * data["g"] + rng.standard_normal(120), rng.standard_normal(120)])
    full = multitrait.fit(y, data["x"], data["k"], data["ids"])
    diagonal = multitrait.fit(y, data["x"], data["k"], data["ids"], "diagonal")
    one = multitrait.fit(y, data["x"], data["k"], data["ids"], "fa1")
    assert full.log_likelihood >= one.log_likelihood - 1e-3 >= diagonal.log_likelihood - 2
    assert np.allclose(diagonal.vg, np.diag(np.diag(diagonal.vg)))
    single = [mixed.fit_null(y[:, k], data["x"], data["k"], data["ids"]) for k in range(3)]
    assert diagonal.log_likelihood == pytest.approx(sum(f.log_likelihood for f in single), abs=0.05)
    pair = multitrait.fit(np.column_stack([y[:, :2], y[:, :2] + rng.standard_normal((120, 2))]), data["x"], data["k"], data["ids"], "separable", (2, 2), rounds=40)
    a, b = linalg.nearest_kronecker(pair.vg, 2, 2)
    assert np.allclose(np.kron(a, b), pair.vg, atol=1e-3)
    with pytest.raises(ValueError):
        multitrait.fit(y, data["x"], data["k"], data["ids"], "none")


def test_kernels_and_interaction(data):
    one = multitrait.fit_kernels(data["y"], data["x"], [data["k"]], data["ids"])
    plain = mixed.fit_null(data["y"], data["x"], data["k"], data["ids"])
    assert one.variances == pytest.approx([plain.sigma2_g, plain.sigma2_e], rel=0.02)
    assert multitrait.score_kernels(data["m"], one)["beta"] == pytest.approx(mixed.score(plain, data["m"])[0], rel=1e-2)
    z = data["x"][:, 1]
    none = multitrait.KernelFit(tuple(data["ids"]), np.eye(120) - data["x"] @ np.linalg.pinv(data["x"]), (np.eye(120) - data["x"] @ np.linalg.pinv(data["x"])) @ data["y"], np.ones(1), 0.0, 117)
    got, want = multitrait.score_gxe(data["m"], (none, z)), glm.score_interaction(data["m"], {"y": data["y"], "x": data["x"], "z": z})
    assert got["beta_main"] == pytest.approx(want["beta_main"]) and got["beta_interact"] == pytest.approx(want["beta_interact"])
    own = multitrait.fit_heteroscedastic(data["y"], data["x"], data["k"], np.arange(120) % 2, data["ids"])
    assert len(own.variances) == 3 and (own.variances > 0).all()
    times = np.array([0.0, 1.0, 3.0])
    lines = multitrait.random_regression(np.outer(np.ones(4), 2 + times), times, 1)
    assert np.allclose(linalg.legendre(linalg.standardised_time(times, 0, 3), 1) @ lines.T, (2 + times)[:, None])


def test_dense_algebra():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    k = a @ a.T
    u = rng.standard_normal((30, 3))
    inverse = np.linalg.inv(k)
    assert np.allclose(linalg.woodbury_inverse(inverse, u, np.eye(3), u.T), np.linalg.inv(k + u @ u.T))
    assert linalg.woodbury_logdet(np.linalg.slogdet(k)[1], inverse, u, np.eye(3), u.T) == pytest.approx(np.linalg.slogdet(k + u @ u.T)[1])
    low = u @ u.T
    factor, added = linalg.safe_cholesky(low)
    assert added > 0 and np.allclose(factor @ factor.T, low, atol=1e-4) and linalg.safe_logdet(k) == pytest.approx(np.linalg.slogdet(k)[1])
    stack = np.stack([k, k + np.eye(30)])
    assert np.allclose(linalg.cholesky_solve(linalg.safe_cholesky(stack)[0], np.ones((2, 30, 1)))[1], np.linalg.solve(stack[1], np.ones((30, 1))))
    want = np.linalg.eigvalsh(k)[::-1][:4]
    assert linalg.randomised_eigen(k, 4, 15, 8)[0] == pytest.approx(want, rel=1e-4)
    assert linalg.block_gradient_eigen(lambda x: k @ x, 30, 4)[0] == pytest.approx(want, rel=1e-6)
    vt, vs, et, es = (m @ m.T + np.eye(len(m)) for m in (rng.standard_normal((2, 2)), rng.standard_normal((3, 3)), rng.standard_normal((2, 2)), rng.standard_normal((3, 3))))
    joint, values = linalg.kronecker_diagonal(vt, vs, et, es), np.array([0.5, 2.0])
    scale, determinant = linalg.kronecker_precision(joint, values)
    for k_, d in enumerate(values):
        v = d * np.kron(vt, vs) + np.kron(et, es)
        t = np.kron(joint.first, joint.second)
        assert np.allclose(t @ np.diag(scale[k_]) @ t.T, np.linalg.inv(v)) and determinant[k_] == pytest.approx(np.linalg.slogdet(v)[1])
    m = rng.standard_normal((4, 6))
    assert np.allclose(linalg.kronecker_back(linalg.kronecker_rotate(m, joint), joint), m)
    load, psi = rng.standard_normal((4, 2)), np.array([0.1, 0.2, 0.3, 0.4])
    inverse, determinant = linalg.factor_precision(load, psi, values)
    v = 2.0 * (load @ load.T + np.diag(psi)) + np.eye(4)
    assert np.allclose(inverse[1], np.linalg.inv(v)) and determinant[1] == pytest.approx(np.linalg.slogdet(v)[1])


def test_bases():
    t = np.linspace(0, 10, 50)
    basis = linalg.bspline(t, linalg.knots(t, 4))
    assert np.allclose(basis.sum(axis=1), 1) and basis.shape == (50, 8)
    surface, rows, columns = linalg.surface(np.repeat(np.arange(6.0), 6), np.tile(np.arange(6.0), 6), 2, 2)
    assert surface.shape == (36, 36) and rows.shape == columns.shape == (36, 36) and np.allclose(surface.sum(axis=1), 1)
    assert np.allclose(linalg.basis_at(t, "bspline", knots=linalg.knots(t, 4)), basis)
    s = np.linspace(-1, 1, 20001)
    assert np.allclose(linalg.legendre(s, 3).T @ linalg.legendre(s, 3) * (s[1] - s[0]), np.eye(4), atol=2e-3)


def test_truncated_normal():
    rng = np.random.default_rng(6)
    x = 1 + 2 * rng.standard_normal(2_000_000)
    own = x[(x > 0) & (x < 2.5)]
    mean, var = linalg.truncated_moments(1.0, 2.0, 0.0, 2.5)
    assert float(mean) == pytest.approx(own.mean(), abs=3e-3) and float(var) == pytest.approx(own.var(), abs=3e-3)
    far, _ = linalg.truncated_moments(0.0, 1.0, 8.0, np.inf)
    assert float(far) == pytest.approx(8.12, abs=0.01)
    cov = np.array([[1.0, 0.5], [0.5, 2.0]])
    draws = rng.multivariate_normal([0.2, -0.1], cov, 1_000_000)
    inside = draws[(draws > [0.0, -1.0]).all(axis=1) & (draws < [np.inf, 1.0]).all(axis=1)]
    mean, var, mass = linalg.truncated_normal(np.array([0.2, -0.1]), cov, np.array([0.0, -1.0]), np.array([np.inf, 1.0]))
    assert mean == pytest.approx(inside.mean(axis=0), abs=0.01) and np.allclose(var, np.cov(inside.T), atol=0.02) and mass == pytest.approx(len(inside) / 1e6, abs=3e-3)


def test_relationships(spark):
    rng = np.random.default_rng(7)
    n, m = 37, 150
    g = rng.binomial(2, 0.4, (n, m)).astype(float)
    ids = sorted(rng.choice(1000, n, replace=False).tolist())
    cells = spark.createDataFrame([(v, ids[s], float(g[s, v])) for v in range(m) for s in range(n)], "v_idx long, s_idx long, dosage double")
    p = g.mean(axis=0) / 2
    x = g - 2 * p
    want = x @ x.T / (2 * p * (1 - p)).sum()
    rows = kinship.encoded(cells)
    for tile in (8, 37, 1024):
        total, norm = kinship.gram(rows, ids, tile)
        assert np.allclose(total / norm, want)
    pairs = {(r.i, r.j): r.k for r in kinship.gram_pairs(rows, ids, 10).collect()}
    assert len(pairs) == n * (n + 1) // 2 and all(pairs[ids[a], ids[b]] == pytest.approx(want[a, b]) for a in range(n) for b in range(a, n))
    assert kinship.sparse_pairs(rows, 0.2, ids, 10).count() == sum(abs(want[a, b]) >= 0.2 or a == b for a in range(n) for b in range(a, n))
    placed = cells.selectExpr("*", "v_idx % 3 as chr")
    left = kinship.leave_one_out(placed, ids)
    for c in range(3):
        keep = np.arange(m) % 3 != c
        assert np.allclose(left[c], x[:, keep] @ x[:, keep].T / (2 * p * (1 - p))[keep].sum())
    assert np.allclose(kinship.relationship(cells, ids, "recoded:additive"), want)
    zhang = kinship.zhang(cells, ids)
    assert np.allclose(zhang, zhang.T) and zhang.max() <= 2 + 1e-9
    values, vectors = linalg.nystrom(cells, ids, n)
    assert np.allclose((vectors * values) @ vectors.T, want, atol=1e-6)
    with pytest.raises(ValueError, match="too large"):
        kinship.gram(rows, list(range(20_000)))


def test_effective_size(spark):
    rng = np.random.default_rng(8)
    plain = rng.standard_normal((4, 2000))
    slow = np.zeros((4, 2000))
    for t in range(1, 2000):
        slow[:, t] = 0.9 * slow[:, t - 1] + rng.standard_normal(4)
    assert pgs.geyer(plain) == pytest.approx(8000, rel=0.15) and pgs.geyer(slow) == pytest.approx(8000 * 0.1 / 1.9, rel=0.3)
    rows = [(name, c, t, float(x[c, t])) for name, x in (("a", plain), ("b", slow)) for c in range(4) for t in range(0, 2000)]
    got = {r.name: r for r in pgs.converged(spark.createDataFrame(rows, "name string, chain int, draw int, value double"), ["name"]).collect()}
    assert got["a"].converged and got["a"].ess > 3 * got["b"].ess


def test_tails_match_sql():
    import duckdb

    from lociframe.plans import tails

    value = lambda e: duckdb.sql(f"SELECT {e}").fetchall()[0][0]
    for z in (0.0, 0.4, 2.1, 5.0, 30.0):
        assert value(tails.norm_sf2(f"{z}::DOUBLE")) == pytest.approx(float(2 * specfun.norm_sf(z)), abs=1e-12)
    assert value(tails.f_sf("3.3::DOUBLE", "2.0::DOUBLE", "57.0::DOUBLE")) == pytest.approx(float(specfun.f_sf(3.3, 2.0, 57.0)), abs=1e-12)
    assert value(tails.norm_ppf("0.003::DOUBLE")) == pytest.approx(float(specfun.norm_ppf(0.003)[0]), abs=1e-8)


def test_sparse_families_are_exact(spark, data):
    rng = np.random.default_rng(9)
    group = np.repeat(np.arange(30), 4)
    k = np.where(group[:, None] == group[None], 0.5, 0.0) + 0.5 * np.eye(120)
    y = data["x"] @ [1.0, 0.3] + rng.standard_normal(30)[group] + 2 * rng.standard_normal(120)
    pairs = spark.createDataFrame([(a, b, float(k[a, b])) for a in range(120) for b in range(a, 120) if k[a, b]], "i long, j long, k double")
    sparse, dense = mixed.fit_sparse(y, data["x"], pairs, data["ids"]), mixed.fit_null(y, data["x"], k, data["ids"])
    assert len(sparse.blocks) == 30 and sparse.log_likelihood == pytest.approx(dense.log_likelihood) and sparse.ratio == pytest.approx(dense.ratio, rel=1e-2)
    assert mixed.score(sparse, data["m"])[0] == pytest.approx(mixed.score(dense, data["m"])[0], rel=1e-3)


def test_hypotheses(spark):
    rng = np.random.default_rng(10)
    assert hypotheses.wald(2.0, 1.0)[1] == pytest.approx(float(specfun.chi2_sf(4.0, 1.0))) and hypotheses.likelihood_ratio(-10.0, -8.0)[0] == 4.0
    cov = np.array([[1.0, 0.3], [0.3, 2.0]])
    stat, p, df = hypotheses.contrast(np.array([1.0, 0.5]), cov, np.array([1.0, -1.0]))
    assert stat == pytest.approx(0.25 / (1 + 2 - 0.6)) and df == 1 and p == pytest.approx(float(specfun.chi2_sf(stat, 1.0)))
    assert hypotheses.score(np.array([1.0, 2.0]), cov)[0] == pytest.approx(np.array([1.0, 2.0]) @ np.linalg.solve(cov, [1.0, 2.0]))
    draws = (rng.standard_normal((400_000, 3)) ** 2) @ [1.0, 0.5, 0.2]
    for method in ("davies", "liu"):
        assert hypotheses.mixture_tail(4.0, np.array([1.0, 0.5, 0.2]), method) == pytest.approx((draws > 4).mean(), abs=5e-3)
    assert hypotheses.effective_tests(np.ones(10))["moskvina"] == pytest.approx(10) and hypotheses.effective_tests(np.array([10.0] + [0.0] * 9))["moskvina"] == pytest.approx(1)
    null, signal = rng.random(3000), rng.random(300) * 1e-4
    rows = spark.createDataFrame([(k, float(p), float(c)) for k, (p, c) in enumerate(zip(np.concatenate([null, signal]), np.concatenate([rng.random(3000), 0.8 + 0.2 * rng.random(300)])))], "v_idx long, p double, c double")
    got = hypotheses.adaptive_thresholds(rows, "c", ["v_idx"]).where("selected").collect()
    false = sum(r.v_idx < 3000 for r in got)
    assert len(got) - false > 270 and false / len(got) < 0.2
    told = hypotheses.inflation(rows.where("v_idx < 3000")).first()
    assert told.lambda_gc == pytest.approx(1, abs=0.12) and told.n == 3000
    same = hypotheses.compare_p(rows, rows).first()
    assert same.correlation == pytest.approx(1) and same.max_gap == 0 and same.share_within == 1
    z = rng.standard_normal(4000) + np.where(np.arange(4000) < 400, 3.0, 0.0)
    table = spark.createDataFrame([(k, float(v), 1.0) for k, v in enumerate(z)], "v_idx long, beta double, se double")
    fixed = hypotheses.bootstrap_winners(table, 20).toPandas().sort_values("v_idx")
    top = np.argsort(-z)[:100]
    truth = np.where(np.arange(4000) < 400, 3.0, 0.0)
    assert abs((fixed["beta_corrected"].to_numpy() - truth)[top].mean()) < (z - truth)[top].mean()
    data = rng.standard_normal((5, 300))
    assert hypotheses.empirical_brown(np.full(5, 0.01), data) < hypotheses.empirical_brown(np.full(5, 0.01), np.tile(data[0], (5, 1)) + 0.01 * data)


def test_trait_summaries(data):
    vg = np.array([[1.0, 0.8], [0.8, 1.0]])
    fit = multitrait.null_fit(np.column_stack([data["y"], data["g"]]), data["x"], data["values"], data["vectors"], data["ids"], vg, np.eye(2))
    assert multitrait.genetic_correlation(vg)[0, 1] == pytest.approx(0.8) and multitrait.heritabilities(fit) == pytest.approx([0.5, 0.5])
    load, rest = multitrait.loadings(vg)
    assert np.allclose(load @ load.T + np.diag(rest), [[1.0, 0.9], [0.9, 1.0]]) and multitrait.interaction_share(vg) == pytest.approx(0.2) and multitrait.stability(vg) == pytest.approx([0.8, 0.8])
    told = multitrait.curves(fit, np.array([0.0, 5.0, 10.0]), 0.0, 10.0)
    assert np.allclose(np.diag(told["correlation"]), 1) and told["heritability"] == pytest.approx(told["genetic"] / (told["genetic"] + told["residual"]))
    share, functions = multitrait.eigenfunctions(fit, np.linspace(0, 10, 5), 0.0, 10.0)
    assert share.sum() == pytest.approx(1) and functions.shape == (5, 2)
    again = multitrait.resume(np.column_stack([data["y"], data["g"]]), data["x"], data["k"], fit)
    assert again.log_likelihood >= fit.log_likelihood
    tests = multitrait.kernel_tests(data["y"], data["x"], [data["k"], np.diag(np.linspace(0.5, 1.5, 120))], data["ids"])
    assert tests[0][1] < 0.05 and tests[0][0] > tests[1][0]
    row, column = np.repeat(np.arange(12.0), 12), np.tile(np.arange(12.0), 12)
    smooth = np.sin(row / 3) + 0.1 * column
    trend, _ = multitrait.spatial_trend(smooth + 0.2 * np.random.default_rng(0).standard_normal(144), row, column)
    assert np.corrcoef(trend, smooth)[0, 1] > 0.97


def test_mediation_paths(spark, data):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.binomial(2, 0.4, n).astype(float)
    m = 0.6 * x + rng.standard_normal(n)
    y = 0.5 * m + 0.2 * x + rng.standard_normal(n)
    c = np.ones((n, 1))
    plain = lambda v: mixed.fit_eigen(v, c, np.zeros(n), np.eye(n), list(range(n)), 1.0)
    got = mediation.mixed_paths(x, m, y, c, plain(m), plain(y))
    cells = spark.createDataFrame([(0, k, float(x[k])) for k in range(n)], "v_idx long, s_idx long, dosage double")
    want = mediation.sobel(spark.createDataFrame([(0, float(a), float(b), float(d)) for a, b, d in zip(x, m, y)], "v_idx long, x double, m double, y double"), ["v_idx"]).first()
    assert [got[k] for k in ("a", "b", "direct", "indirect", "z", "proportion")] == pytest.approx([want[k] for k in ("a", "b", "direct", "indirect", "z", "proportion")], rel=1e-6)
    table = spark.createDataFrame([("f", k, float(m[k])) for k in range(n)], "feature string, s_idx long, m double")
    pairs = spark.createDataFrame([("f", 0)], "feature string, v_idx long")
    assert mediation.scan_mixed(cells, table, pairs, y, c, plain(m), plain(y)).first().indirect == pytest.approx(got["indirect"])
    for se, low, high in (mediation.monte_carlo(got["a"], got["se_a"], got["b"], got["se_b"]), mediation.bootstrap(x, m, y, 400)):
        assert se == pytest.approx(got["se"], rel=0.2) and low < got["indirect"] < high
    shares = mediation.kernel_shares(data["y"], data["x"], data["k"], rng.standard_normal((120, 50)), data["ids"])
    assert shares["genetic"] + shares["expression"] + shares["residual"] == pytest.approx(1) and shares["genetic"] > shares["expression"]
