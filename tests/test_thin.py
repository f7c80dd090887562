"""Models on a relationship's factor give what they give on the full matrix."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__
from lociframe.operators import glmm, haplotypes, kinship, mixed, multitrait, thin

RNG = np.random.default_rng(5)
N, M = 90, 25
Z = RNG.integers(0, 3, (N, M)) - 1.0
Z -= Z.mean(axis=0)
K = thin.Thin(Z / np.sqrt(M / 2))
X = np.column_stack([np.ones(N), RNG.standard_normal(N)])
U = K.factor @ RNG.standard_normal(M) * 0.8
Y = U + 0.3 * X[:, 1] + RNG.standard_normal(N)
G = RNG.integers(0, 3, (N, 6)).astype(float)
IDS = list(range(N))


def same(a: dict, b: dict, tol: float = 1e-5) -> None:
    for k in a:
        assert np.allclose(a[k], b[k], rtol=tol, atol=tol, equal_nan=True), k


@pytest.mark.parametrize("family", ["identity", "logit", "probit", "log"])
def test_generalised(family):
    y = {"identity": Y, "log": RNG.poisson(np.exp(0.3 * U)).astype(float)}.get(family, (Y > 0).astype(float))
    a, b = (glmm.fit(y, X, k, IDS, family) for k in (K, K.dense()))
    assert np.isclose(a.tau, b.tau, rtol=1e-4, atol=1e-6) and np.allclose(a.effects, b.effects, atol=1e-5)
    same(glmm.score(G, a), glmm.score(G, b))


def test_ordinal_and_multinomial():
    level = np.digitize(Y, [-0.7, 0.7])
    a, b = (glmm.fit_ordinal(level, X[:, 1:], k, IDS) for k in (K, K.dense()))
    same(glmm.score(G, a), glmm.score(G, b))
    a, b = (glmm.fit_multinomial(level, X, k, IDS, tau=t) for k in (K, K.dense()) for t in [0.4])
    same(glmm.score_multinomial(G, a), glmm.score_multinomial(G, b))


@pytest.mark.parametrize("tau", [None, 0.0, 0.5])
def test_survival_with_ties(tau):
    time = np.round(RNG.exponential(np.exp(-0.4 * U)), 1)
    event = (RNG.random(N) < 0.7).astype(float)
    a, b = (glmm.fit_survival(time, event, X[:, 1:], k, IDS, tau=tau) for k in (K, K.dense()))
    same(glmm.score(G, a), glmm.score(G, b))


def test_linear():
    a, b = (mixed.fit_null(Y, X, k, IDS) for k in (K, K.dense()))
    assert np.isclose(a.log_likelihood, b.log_likelihood)
    for left, right in zip(mixed.score(a, G), mixed.score(b, G), strict=True):
        assert np.allclose(left, right, atol=1e-6)
    values, vectors = mixed.eigen(K)
    full = mixed.eigen(K.dense())
    same(mixed.refit(G, {"y": Y, "x": X, "values": values, "vectors": vectors}), mixed.refit(G, {"y": Y, "x": X, "values": full[0], "vectors": full[1]}))


@pytest.mark.parametrize("structure", ["unstructured", "diagonal", "fa1"])
def test_several_traits(structure):
    y = np.column_stack([Y, 0.5 * U + RNG.standard_normal(N)])
    a, b = (multitrait.fit(y, X, k, IDS, structure) for k in (K, K.dense()))
    assert np.isclose(a.log_likelihood, b.log_likelihood, atol=1e-5) and np.allclose(a.vg, b.vg, atol=2e-3) and np.allclose(a.ve, b.ve, atol=2e-3)
    values, vectors, _ = thin.axes(K, y, X)
    a = multitrait.null_fit(y, X, values, vectors, IDS, b.vg, b.ve)
    same(multitrait.score(G, a), multitrait.score(G, b))
    same(multitrait.score_environments(G, a), multitrait.score_environments(G, b))
    assert np.allclose(haplotypes.multi_test(G[:, :2], a), haplotypes.multi_test(G[:, :2], b))


def test_kernels_and_residual_variances():
    z = X[:, 1]
    a, b = (multitrait.fit_kernels(Y, X, multitrait.interaction_kernels(k, z), IDS) for k in (K, K.dense()))
    assert np.isclose(a.log_likelihood, b.log_likelihood, atol=1e-6) and np.allclose(a.variances, b.variances, atol=1e-4)
    same(multitrait.score_gxe(G, (a, z)), multitrait.score_gxe(G, (b, z)), 1e-4)
    a, b = (multitrait.fit_heteroscedastic(Y * (1 + np.arange(N) % 3), X, k, np.arange(N) % 3, IDS) for k in (K, K.dense()))
    assert np.isclose(a.log_likelihood, b.log_likelihood, atol=1e-6) and np.allclose(a.variances, b.variances, rtol=1e-3, atol=1e-4)
    same(multitrait.score_kernels(G, a), multitrait.score_kernels(G, b), 1e-4)


def _cells(spark):
    rows = [(v, s * 3, float(RNG.integers(0, 3))) for v in range(4) for s in range(12) if (v + s) % 7]
    return spark.createDataFrame(rows, "v_idx long, s_idx long, dosage double")


@pytest.mark.parametrize("kind", ["vanraden", "dominance"])
def test_factor_of_calls(spark, kind):
    ids = [s * 3 for s in range(12)]
    cells = _cells(spark)
    if kind == "dominance":
        cells = cells.where("(v_idx + s_idx / 3) % 7 <> 0")
    found = thin.relationship(cells, ids, kind)
    assert isinstance(found, thin.Thin) and np.allclose(found.dense(), kinship.relationship(cells, ids, kind))


@pytest.mark.parametrize("name", ["glmm_logit", "glmm_ordinal", "glmm_survival", "glmm_multinomial", "lmm_scan_refit", "haplotype_scan", "multi_env_unstructured", "heteroscedastic_lmm", "gxe_lmm"])
def test_queries_need_no_full_matrix(spark, sf, monkeypatch, name):
    """With fewer variants than samples, as in large tables."""
    from lociframe.plans import views

    geno = views.geno
    monkeypatch.setattr(views, "geno", lambda spark, sf: geno(spark, sf).where("v_idx < 6"))
    monkeypatch.setattr(kinship, "MOST_SAMPLES", 5)
    assert __spark_entry__.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("family", ["logit", "ordinal"])
def test_environments_with_unseen_cells(family):
    from lociframe.operators import env_glmm

    y = np.column_stack([np.digitize(U + RNG.standard_normal(N), [-0.5, 0.6]), np.digitize(0.7 * U + RNG.standard_normal(N), [-0.4, 0.5])]).astype(float)
    y = (y > 0).astype(float) if family == "logit" else y
    y[RNG.random(y.shape) < 0.1] = np.nan
    x = X[:, 1:] if family == "ordinal" else X
    for rounds in (6, 60):
        with pytest.warns() if rounds == 6 else __import__("contextlib").nullcontext():
            a, b = (env_glmm.fit(y, x, k, IDS, family, rounds=rounds) for k in (K, K.dense()))
        assert np.allclose(a.sigma, b.sigma, atol=1e-5) and np.allclose(a.beta, b.beta, atol=1e-5) and a.rounds == b.rounds
        same(env_glmm.score(G, (a, 2.0)), env_glmm.score(G, (b, 2.0)))


@pytest.mark.parametrize("ordered", [[0], [0, 1]])
def test_ordered_traits_with_unseen_cells(ordered):
    from lociframe.operators import liability

    y = np.column_stack([np.digitize(U + RNG.standard_normal(N), [-0.5, 0.6]), (0.7 * U + RNG.standard_normal(N) > 0), Y]).astype(float)
    y = y if len(ordered) == 2 else y[:, [0, 2]]
    y[RNG.random(y.shape) < 0.1] = np.nan
    vg = np.eye(y.shape[1]) * 0.4 + 0.2
    ve = np.eye(y.shape[1]) * 0.8 + 0.2
    a, b = (liability.fit(y, X, k, IDS, ordered, vg, ve) for k in (K, K.dense()))
    assert np.allclose(a.liabilities, b.liabilities, atol=1e-6) and np.isclose(a.objective, b.objective) and np.allclose(a.beta, b.beta, atol=1e-6)
    same(liability.score(G, a), liability.score(G, b))
    left, right = (liability.components(y, ordered, X, k, IDS) for k in (K, K.dense()))
    assert np.allclose(left[0], right[0], atol=5e-3) and np.allclose(left[1], right[1], atol=5e-3)


@pytest.mark.parametrize("name", ["multi_env_glmm_binary", "multi_env_glm_binary", "liability_scan", "liability_independent"])
def test_stacked_queries_need_no_full_matrix(spark, sf, monkeypatch, name):
    """A budget that the stacked rows of 10 samples exceed and a factor doesn't."""
    from lociframe.plans import views

    geno = views.geno
    monkeypatch.setattr(views, "geno", lambda spark, sf: geno(spark, sf).where("v_idx < 6"))
    monkeypatch.setattr(mixed, "MOST_BYTES", 1200)
    assert __spark_entry__.queries()[name](spark, sf).count() > 0


def test_curves_with_two_kernels_and_unseen_environments():
    from lociframe.operators import env_curves

    n = 90
    x, two = X[:n], [K.of(np.arange(n)), thin.Thin(np.random.default_rng(8).standard_normal((n, 9)) / 3)]
    shared = two[0].factor @ RNG.standard_normal((M, 4)) + two[1].factor @ RNG.standard_normal((9, 4)) * 0.7
    y = 3 * (shared @ (np.eye(4) + 0.5) + RNG.standard_normal((n, 4)))
    y[:5, [0, 2]] = np.nan
    y[5:9, [1, 3]] = np.nan
    a = env_curves._factored(y, x, two, 2, 2, "separable", 300)
    b = env_curves._stacked(y, x, [k.dense() for k in two], 2, 2, "separable", 300)
    assert np.isclose(a[1], b[1], atol=1e-4)
    assert all(np.allclose(p, q, atol=0.05 * np.abs(q).max()) for p, q in zip(a[0], b[0], strict=True))
    g = G[:n]
    assert np.allclose(a[3].residual @ g, b[3].residual @ g, atol=0.02)
    dense = np.array([[(g * (b[3].projection[s, :, t] @ g)).sum(0) for t in range(4)] for s in range(4)])
    assert np.allclose(a[3].projection.forms(g), dense, rtol=0.02, atol=0.02 * np.abs(dense).max())
