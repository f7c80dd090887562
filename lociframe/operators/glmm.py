"""Generalised linear mixed models: penalised quasi-likelihood null fits on the driver, score tests in Spark.

A family says how the mean follows from the linear predictor and what variance it has. The null
model eta = X b + u, u ~ N(0, tau K), is fitted by repeated weighted mixed models on a working
response. The scan then needs, for each variant, its score against the residuals and its variance
under the null, W^-1 + tau K; that is one product with a broadcast matrix of samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lociframe.functions import specfun

from . import mixed, thin
from .packed import map_variants


@dataclass(frozen=True)
class Family:
    """Mean, its derivative, variance and link, as functions of the linear predictor or the mean."""

    mean: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray]
    variance: Callable[[np.ndarray], np.ndarray]
    link: Callable[[np.ndarray], np.ndarray]
    dispersed: bool = False


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -30, 30)))


FAMILIES = {
    "identity": Family(lambda e: e, np.ones_like, np.ones_like, lambda m: m, dispersed=True),
    "logit": Family(_logistic, lambda e: _logistic(e) * (1 - _logistic(e)), lambda m: m * (1 - m), lambda m: np.log(m / (1 - m))),
    "probit": Family(lambda e: specfun.norm_cdf(np.clip(e, -8, 8)), lambda e: specfun.norm_pdf(np.clip(e, -8, 8)), lambda m: m * (1 - m), lambda m: specfun.norm_ppf(m)),
    "log": Family(lambda e: np.exp(np.clip(e, -30, 30)), lambda e: np.exp(np.clip(e, -30, 30)), lambda m: m, lambda m: np.log(np.maximum(m, 1e-10))),
}


@dataclass(frozen=True)
class NullFit:
    """What the scan needs: residuals, the projection of the null model and tau."""

    samples: tuple[int, ...]
    residual: np.ndarray
    projection: np.ndarray
    tau: float
    beta: np.ndarray
    effects: np.ndarray
    mean: np.ndarray
    rounds: int


def _weighted(z: np.ndarray, x: np.ndarray, w: np.ndarray, kinship: np.ndarray, tau: float | None, dispersed: bool) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """(tau, phi, beta, u, P) of z = x b + u + e, e ~ N(0, phi / w); phi is 1 unless ``dispersed``."""
    if isinstance(kinship, thin.Thin):
        return thin.weighted(z, x, w, kinship, tau, dispersed)
    n, c = x.shape
    root = np.sqrt(w)
    zs, xs = root * z, root[:, None] * x
    values, vectors = np.linalg.eigh(root[:, None] * kinship * root[None])
    values = np.maximum(values, 0)
    if tau is None:
        if dispersed:
            tau = mixed.best_ratio(lambda r: mixed.profile(zs, xs, values, vectors)(r)[0])
        else:
            uz, ux = vectors.T @ zs, vectors.T @ xs

            def likelihood(t: float) -> float:
                v = 1 / (t * values + 1)
                gram = ux.T @ (v[:, None] * ux)
                b = np.linalg.solve(gram, ux.T @ (v * uz))
                r = uz - ux @ b
                return -0.5 * (-np.log(v).sum() + np.linalg.slogdet(gram)[1] + (v * r * r).sum())

            tau = mixed.best_ratio(likelihood, -12.0, 5.0, 69)
            if likelihood(1e-8) >= likelihood(tau) - 1e-9:
                tau = 0.0
    h = (vectors * (1 / (tau * values + 1))) @ vectors.T
    gram = xs.T @ h @ xs
    beta = np.linalg.solve(gram, xs.T @ h @ zs)
    r = h @ (zs - xs @ beta)
    phi = float((zs - xs @ beta) @ r) / (n - c) if dispersed else 1.0
    u = tau * kinship @ (root * r)
    inverse = root[:, None] * h * root[None]
    ix = inverse @ x
    return tau, phi, beta, u, (inverse - ix @ np.linalg.solve(gram, ix.T)) / phi


def fit(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], family: str = "logit", rounds: int = 50, tol: float = 1e-6, tau: float | None = None) -> NullFit:
    """Penalised quasi-likelihood: working response and weights, variance by REML, until predictor and variance settle. ``tau`` fixes the variance."""
    f = FAMILIES[family]
    low, high = (0.01, 0.99) if family in ("logit", "probit") else (1e-3, np.inf)
    start = y if family == "identity" else np.full(len(y), np.clip(y.mean(), low, high))
    eta, found = f.link(start) * np.ones(len(y)), tau if tau is not None else 0.0
    for n in range(rounds):
        mu, slope = f.mean(eta), np.maximum(f.slope(eta), 1e-8)
        w = np.maximum(slope**2 / np.maximum(f.variance(mu), 1e-10), 1e-8)
        new_tau, phi, beta, u, p = _weighted(eta + (y - mu) / slope, x, w, kinship, tau, f.dispersed)
        new = x @ beta + u
        moved = max(np.abs(new - eta).max(), abs(new_tau - found))
        eta, found = new, new_tau
        if moved < tol * (1 + np.abs(eta).max()):
            break
    mu, slope = f.mean(eta), np.maximum(f.slope(eta), 1e-8)
    score = (y - mu) * slope / np.maximum(f.variance(mu), 1e-10) / phi
    return NullFit(tuple(samples), score, p, found * phi, beta, u, mu, n + 1)


def score(g: np.ndarray, fit: NullFit) -> dict[str, np.ndarray]:
    """beta, se, chi2 and p of columns: their score against the residuals over its variance under the null model."""
    u, info = g.T @ fit.residual, (g * (fit.projection @ g)).sum(axis=0)
    ok = info > 1e-10
    info = np.where(ok, info, 1.0)
    chi2 = np.where(ok, u * u / info, np.nan)
    return {"beta": np.where(ok, u / info, np.nan), "se": np.where(ok, 1 / np.sqrt(info), np.nan), "chi2": chi2, "p": np.where(ok, np.clip(specfun.chi2_sf(np.nan_to_num(chi2), 1.0), specfun.FLOOR, 1), np.nan)}


def scan(cells: DataFrame, fit: NullFit) -> DataFrame:
    """(v_idx, beta, se, chi2, p)."""
    if fit.projection.nbytes > mixed.MOST_BYTES:
        raise ValueError(f"the projection of {len(fit.samples)} samples is too large to broadcast")
    return map_variants(cells, list(fit.samples), score, fit, "beta double, se double, chi2 double, p double")


# Ordered and unordered categories: stacked binary responses with one random effect for each boundary or category.


@dataclass(frozen=True)
class CategoryFit:
    """Residuals and weights by category, and the scan's projection over stacked responses."""

    samples: tuple[int, ...]
    residual: np.ndarray
    projection: np.ndarray
    tau: float
    shared: bool


def _stacked(residual: np.ndarray, weights: np.ndarray, designs: np.ndarray, kinship: np.ndarray, tau: float, samples: list[int], shared: bool) -> CategoryFit:
    """The projection of a stacked model; weights (k, k, n) couple the categories of a sample."""
    k, n = residual.shape
    if isinstance(kinship, thin.Thin):
        return CategoryFit(tuple(samples), residual, thin.stacked(weights, designs[:n, : designs.shape[1] // k], kinship, tau), tau, shared)
    full = np.zeros((k * n, k * n))
    at = np.arange(n)
    for a in range(k):
        for b in range(k):
            full[a * n + at, b * n + at] = weights[a, b]
    effect = np.kron(np.ones((k, k)) if shared else np.eye(k), kinship) * tau
    inverse = np.linalg.solve(np.eye(k * n) + full @ effect, full) if tau else full
    ix = inverse @ designs
    return CategoryFit(tuple(samples), residual, inverse - ix @ np.linalg.pinv(designs.T @ ix) @ ix.T, tau, shared)


def fit_multinomial(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], rounds: int = 30, tau: float | None = None) -> CategoryFit:
    """Baseline-category logits with a random effect of common variance in each; categories are 0 .. k, the baseline is 0."""
    k, n = int(y.max()), len(y)
    c = x.shape[1]
    flags = np.stack([(y == j + 1).astype(float) for j in range(k)])
    beta, u = np.zeros((k, c)), np.zeros((k, n))
    beta[:, 0] = np.log(np.clip(flags.mean(axis=1), 1e-3, 1) / np.clip((y == 0).mean(), 1e-3, 1))
    found = tau if tau is not None else 0.1
    for _ in range(rounds):
        eta = np.clip(beta @ x.T + u, -30, 30)
        e = np.exp(eta)
        mu = e / (1 + e.sum(axis=0))
        before = eta
        taus = []
        for j in range(k):
            w = np.maximum(mu[j] * (1 - mu[j]), 1e-8)
            t, _, beta[j], u[j], _ = _weighted(eta[j] + (flags[j] - mu[j]) / w, x, w, kinship, tau, False)
            taus.append(t)
        found = float(np.mean(taus))
        if np.abs(beta @ x.T + u - before).max() < 1e-6:
            break
    eta = np.clip(beta @ x.T + u, -30, 30)
    e = np.exp(eta)
    mu = e / (1 + e.sum(axis=0))
    weights = np.stack([[mu[a] * ((a == b) - mu[b]) for b in range(k)] for a in range(k)])
    return _stacked(flags - mu, weights, np.kron(np.eye(k), x), kinship, found, samples, False)


def score_multinomial(g: np.ndarray, fit: CategoryFit) -> dict[str, np.ndarray]:
    """Joint test over the categories, chi-square in their number."""
    k, n = fit.residual.shape
    stat = np.full(g.shape[1], np.nan)
    u = fit.residual @ g
    if isinstance(fit.projection, thin.StackedProjection):
        pg = fit.projection.forms(g)
    else:
        blocks = fit.projection.reshape(k, n, k, n)
        pg = np.stack([[g * (blocks[a, :, b] @ g) for b in range(k)] for a in range(k)]).sum(axis=2)
    for m in range(g.shape[1]):
        v = pg[:, :, m]
        if np.linalg.eigvalsh((v + v.T) / 2)[0] > 1e-9:
            stat[m] = u[:, m] @ np.linalg.solve(v, u[:, m])
    return {"chi2": stat, "p": np.where(np.isnan(stat), np.nan, np.clip(specfun.chi2_sf(np.nan_to_num(stat), float(k)), specfun.FLOOR, 1))}


def scan_multinomial(cells: DataFrame, fit: CategoryFit) -> DataFrame:
    return map_variants(cells, list(fit.samples), score_multinomial, fit, "chi2 double, p double")


def fit_ordinal(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], rounds: int = 100, tau: float | None = None) -> NullFit:
    """Cumulative logits with one random effect for each sample: P(y <= j) = logistic(threshold_j - x b - u).

    x has no intercept. Newton steps on the sample's predictor alternate with thresholds and variance.
    """
    k, n = int(y.max()), len(y)
    thresholds = np.array([math.log(p / (1 - p)) for p in np.clip([(y <= j).mean() for j in range(k)], 0.01, 0.99)])
    design = x - x.mean(axis=0) if x.size else np.zeros((n, 0))
    eta, found = np.zeros(n), 0.0
    one = np.ones((n, 1))
    for step in range(rounds):
        score_, info = _ordinal(y, eta, thresholds)
        w = np.maximum(info, 1e-6)
        full = np.column_stack([one, design])
        t, _, beta, u, _ = _weighted(eta + score_ / w, full, w, kinship, tau, False)
        # the mean of the predictor belongs to the thresholds
        new = design @ beta[1:] + u
        for _ in range(5):
            gradient, hessian = _threshold_steps(y, new, thresholds)
            moved = np.linalg.solve(hessian + 1e-8 * np.eye(k), gradient)
            thresholds = np.maximum.accumulate(thresholds + np.clip(moved, -1, 1))
            thresholds = thresholds + 1e-6 * np.arange(k)
        change = max(np.abs(new - eta).max(), abs(t - found))
        eta, found = new, t
        if change < 1e-6:
            break
    score_, info = _ordinal(y, eta, thresholds)
    w = np.maximum(info, 1e-6)
    _, _, beta, u, p = _weighted(eta + score_ / w, np.column_stack([one, design]), w, kinship, found, False)
    return NullFit(tuple(samples), score_, p, found, np.concatenate([thresholds, beta[1:]]), u, eta, step + 1)


def _ordinal(y: np.ndarray, eta: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and expected information of each sample's predictor in the cumulative logit model."""
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upto = _logistic_wide(edges[None] - eta[:, None])
    slope = upto * (1 - upto)
    chance = np.maximum(np.diff(upto, axis=1), 1e-10)
    per = -np.diff(slope, axis=1) / chance
    return per[np.arange(len(y)), y], (chance * per**2).sum(axis=1)


def _threshold_steps(y: np.ndarray, eta: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upto = _logistic_wide(edges[None] - eta[:, None])
    slope = upto * (1 - upto)
    chance = np.maximum(np.diff(upto, axis=1), 1e-10)
    k = len(thresholds)
    gradient, hessian = np.zeros(k), np.zeros((k, k))
    for j in range(k):
        gradient[j] = (slope[y == j, j + 1] / chance[y == j, j]).sum() - (slope[y == j + 1, j + 1] / chance[y == j + 1, j + 1]).sum()
        hessian[j, j] = (slope[:, j + 1] ** 2 * (1 / chance[:, j] + 1 / chance[:, j + 1])).sum()
        if j + 1 < k:
            hessian[j, j + 1] = hessian[j + 1, j] = -(slope[:, j + 1] * slope[:, j + 2] / chance[:, j + 1]).sum()
    return gradient, hessian


def _logistic_wide(e: np.ndarray) -> np.ndarray:
    return np.where(e == -np.inf, 0.0, np.where(e == np.inf, 1.0, _logistic(np.where(np.isinf(e), 0.0, e))))


def fit_survival(time: np.ndarray, event: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], rounds: int = 50, tau: float | None = None) -> NullFit:
    """Proportional hazards with a frailty of covariance tau K: martingale residuals as the working response, Breslow's cumulative hazard. x has no intercept."""
    n = len(time)
    order = np.argsort(time, kind="stable")
    eta, found = np.zeros(n), 0.0
    design = x - x.mean(axis=0) if x.size else np.zeros((n, 0))
    full = np.column_stack([np.ones(n), design])
    for step in range(rounds):
        risk = np.exp(np.clip(eta, -30, 30))
        at_risk = np.cumsum(risk[order][::-1])[::-1]
        # tied times share the risk set of the first of them
        first = np.searchsorted(time[order], time[order], side="left")
        last = np.searchsorted(time[order], time[order], side="right") - 1
        hazard = np.empty(n)
        hazard[order] = np.cumsum(event[order] / at_risk[first])[last]
        expected = np.maximum(hazard * risk, 1e-8)
        residual = event - expected
        t, _, beta, u, p = _weighted(eta + residual / expected, full, expected, kinship, tau, False)
        new = design @ beta[1:] + u
        new = new - new.mean()
        change = max(np.abs(new - eta).max(), abs(t - found))
        eta, found = new, t
        if change < 1e-6:
            break
    # the partial likelihood's information: expected events less what each risk set shares
    shared = np.empty(n)
    shared[order] = np.cumsum(event[order] / at_risk[first] ** 2)[last]
    if isinstance(kinship, thin.Thin):
        weights = thin.HazardWeights(order, first, expected, risk, shared)
        return NullFit(tuple(samples), residual, thin.inverse_projection(weights, design, kinship, found), found, beta[1:], u, expected, step + 1)
    earlier = np.where(time[:, None] <= time[None], shared[:, None], shared[None])
    w = np.diag(expected) - risk[:, None] * risk[None] * earlier
    inverse = np.linalg.solve(np.eye(n) + found * w @ kinship, w) if found else w
    ix = inverse @ design
    projection = inverse - ix @ np.linalg.pinv(design.T @ ix) @ ix.T if design.shape[1] else inverse
    return NullFit(tuple(samples), residual, projection, found, beta[1:], u, expected, step + 1)
