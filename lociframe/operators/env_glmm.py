"""Binary, count or ordered traits in several environments: quasi-likelihood null fit, score tests in Spark.

eta_ie = x_i b_e + u_ie, cov(u_ie, u_jf) = Sigma_ef K_ij. The working weights differ between the
environments of a sample, so no eigenbasis makes samples independent; the fit works on the stacked
rows (environment, sample) that were seen. A sample may lack some environments. Sigma takes one
average-information step for each round of working responses, or one of expectation maximisation
where that leaves the cone; both have the same resting point.

The scan tests a variant's scores U_e = g' s_e with covariance V_ef = g' P_ef g: all environments
jointly, one by one, a common effect, and differences between environments. The joint statistic is
the sum of the last two.

Scale: the null fit holds a matrix of stacked rows, which is checked against `mixed.MOST_BYTES`;
the scan streams packed variants against the broadcast projection.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from lociframe.functions import specfun

from . import glm, glmm, mixed, thin
from .packed import map_variants


@dataclass(frozen=True)
class EnvironmentFit:
    """Scores and means (environments x samples, 0 where unseen) and the projection over stacked rows."""

    samples: tuple[int, ...]
    family: str
    design: np.ndarray
    seen: np.ndarray
    residual: np.ndarray
    mean: np.ndarray
    projection: np.ndarray | thin.StackedProjection  # (e, n, e, n)
    sigma: np.ndarray
    beta: np.ndarray
    thresholds: np.ndarray | None
    rounds: int
    settled: bool


def _covariance_step(sigma: np.ndarray, p: np.ndarray, r: np.ndarray, env: np.ndarray, near: np.ndarray, samples: int, careful: bool) -> np.ndarray:
    """Sigma after one step; r = P z, near = kinship of the stacked rows."""
    e = len(sigma)
    own = [env == k for k in range(e)]
    shift = np.stack([near[:, o] @ r[o] for o in own], axis=1)
    quad, trace = np.empty((e, e)), np.empty((e, e))
    for a in range(e):
        for b in range(e):
            quad[a, b] = r[own[a]] @ shift[own[a], b]
            trace[a, b] = (p[np.ix_(own[a], own[b])] * near[np.ix_(own[a], own[b])]).sum()
    pairs = [(a, b) for a in range(e) for b in range(a, e)]
    moves = np.stack([np.where(own[a], shift[:, b], 0.0) + (np.where(own[b], shift[:, a], 0.0) if a != b else 0.0) for a, b in pairs], axis=1)
    return _stepped(sigma, quad, trace, lambda: moves.T @ p @ moves, samples, careful)


def _thin_step(sigma: np.ndarray, found: thin.Solved, samples: int, careful: bool) -> np.ndarray:
    """The step of `_covariance_step` by the factor of the relationship."""
    e, q = len(sigma), found.q
    rank = q.shape[1]
    trace = np.array([[np.trace(found.within[a * rank : (a + 1) * rank, b * rank : (b + 1) * rank]) for b in range(e)] for a in range(e)])
    moves = np.zeros((e, rank, e * (e + 1) // 2))
    for k, (a, b) in enumerate((a, b) for a in range(e) for b in range(a, e)):
        moves[a, :, k] += q[b]
        if a != b:
            moves[b, :, k] += q[a]
    moves = moves.reshape(e * rank, -1)
    return _stepped(sigma, q @ q.T, trace, lambda: moves.T @ found.within @ moves, samples, careful)


def _stepped(sigma: np.ndarray, quad: np.ndarray, trace: np.ndarray, information, samples: int, careful: bool) -> np.ndarray:
    e = len(sigma)
    em = sigma + sigma @ (quad - trace) @ sigma / samples
    if careful:
        return em
    pairs = [(a, b) for a in range(e) for b in range(a, e)]
    score = np.array([(1.0 if a == b else 2.0) * (quad[a, b] - trace[a, b]) / 2 for a, b in pairs])
    delta = np.linalg.lstsq(information() / 2, score, rcond=None)[0]
    new = sigma.copy()
    for (a, b), d in zip(pairs, delta, strict=True):
        new[a, b] = new[b, a] = sigma[a, b] + d
    values, vectors = np.linalg.eigh(new)
    if values[0] >= 0:
        return new
    # a step somewhat beyond the cone is put back on it, one far beyond gives way to expectation maximisation
    if e == 1 or values[0] > -0.5 * max(values[-1], 1e-12):
        return (vectors * np.maximum(values, 0)) @ vectors.T
    return em


def fit(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], family: str = "logit", sigma: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-6) -> EnvironmentFit:
    """Null model of y (samples x environments, nan where unseen). ``sigma`` fixes the covariance.

    x has an intercept, but for ``family="ordinal"``, whose thresholds (one set for each environment) stand for it.
    """
    n, e = y.shape
    seen = ~np.isnan(y).T
    env, who = np.nonzero(seen)
    factored = isinstance(kinship, thin.Thin)
    if not factored and len(env) ** 2 * 8 > mixed.MOST_BYTES:
        raise ValueError(f"{len(env)} rows of samples and environments are too many for a dense fit")
    ordinal = family == "ordinal"
    inner = np.column_stack([np.ones(n), x - x.mean(axis=0)]) if ordinal else x
    c = inner.shape[1]
    stacked = y.T[seen]
    own = [env == k for k in range(e)]
    full = np.zeros((len(env), e * c))
    for k in range(e):
        full[own[k], k * c : (k + 1) * c] = inner[who[own[k]]]
    near = None if factored else kinship[np.ix_(who, who)]
    thresholds = None
    if ordinal:
        level = stacked.astype(int)
        top = int(level.max())
        shares = np.array([[(level[o] <= j).mean() for j in range(top)] for o in own])
        thresholds = np.log(np.clip(shares, 0.01, 0.99) / (1 - np.clip(shares, 0.01, 0.99)))
        eta = np.zeros(len(env))
    else:
        f = glmm.FAMILIES[family]
        if family in ("logit", "probit") and not np.isin(stacked, (0, 1)).all():
            raise ValueError("a binary trait is 0 or 1")
        low, high = (0.01, 0.99) if family in ("logit", "probit") else (1e-3, np.inf)
        eta = np.concatenate([np.full(o.sum(), f.link(np.clip(stacked[o].mean(), low, high))) for o in own])

    def working(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score and information of each predictor, and the mean."""
        if ordinal:
            parts = [glmm._ordinal(level[o], eta[o], thresholds[k]) for k, o in enumerate(own)]
            return np.concatenate([s for s, _ in parts]), np.maximum(np.concatenate([w for _, w in parts]), 1e-6), eta
        mu = f.mean(eta)
        slope, variance = np.maximum(f.slope(eta), 1e-8), np.maximum(f.variance(mu), 1e-10)
        return (stacked - mu) * slope / variance, np.maximum(slope**2 / variance, 1e-8), mu

    def project(w: np.ndarray, cov: np.ndarray):
        effect = cov[np.ix_(env, env)] * near
        inverse = np.linalg.inv(np.diag(1 / w) + effect)
        ix = inverse @ full
        gram = np.linalg.pinv(full.T @ ix)
        return inverse - ix @ gram @ ix.T, gram @ ix.T, effect

    def solved(w: np.ndarray, z: np.ndarray, cov: np.ndarray) -> thin.Solved:
        weights, wz = np.zeros((e, e, n)), np.zeros((e, n))
        weights[env, env, who], wz[env, who] = w, w * z
        return thin.solve(weights, wz, inner, kinship, cov)

    cov, settled = np.eye(e) * 0.2 if sigma is None else np.asarray(sigma, float), False
    for step in range(rounds):
        s, w, _ = working(eta)
        z = eta + s / w
        if factored:
            at = solved(w, z, cov)
            beta = at.beta.ravel()
            new_cov = cov if sigma is not None else _thin_step(cov, at, n, step < 3)
            new = full @ beta + (cov @ at.q @ kinship.factor.T)[env, who]
        else:
            p, solve, effect = project(w, cov)
            r, beta = p @ z, solve @ z
            new_cov = cov if sigma is not None else _covariance_step(cov, p, r, env, near, n, step < 3)
            new = full @ beta + effect @ r
        if ordinal:
            for k, o in enumerate(own):
                new[o] -= beta[k * c]
                for _ in range(5):
                    gradient, hessian = glmm._threshold_steps(level[o], new[o], thresholds[k])
                    moved = np.clip(np.linalg.solve(hessian + 1e-8 * np.eye(top), gradient), -1, 1)
                    thresholds[k] = np.maximum.accumulate(thresholds[k] + moved) + 1e-6 * np.arange(top)
        change = max(np.abs(new - eta).max(), np.abs(new_cov - cov).max())
        eta, cov = new, new_cov
        if change < tol * (1 + np.abs(eta).max()):
            settled = True
            break
    if not settled:
        warnings.warn(f"the null fit had not settled after {rounds} rounds", stacklevel=2)
    s, w, mu = working(eta)
    residual, mean = np.zeros((e, n)), np.zeros((e, n))
    residual[seen], mean[seen] = s, mu
    if factored:
        at = solved(w, eta + s / w, cov)
        return EnvironmentFit(tuple(samples), family, inner, seen, residual, mean, at.projection, cov, at.beta, thresholds, step + 1, settled)
    p, solve, _ = project(w, cov)
    projection = np.zeros((e * n, e * n))
    at = np.flatnonzero(seen.ravel())
    projection[np.ix_(at, at)] = p
    return EnvironmentFit(tuple(samples), family, inner, seen, residual, mean, projection.reshape(e, n, e, n), cov, (solve @ (eta + s / w)).reshape(e, c), thresholds, step + 1, settled)


def _tail(stat: np.ndarray, df: int) -> np.ndarray:
    return np.where(np.isnan(stat), np.nan, np.clip(specfun.chi2_sf(np.nan_to_num(stat), float(df)), specfun.FLOOR, 1))


def _saddlepoint(g: np.ndarray, u: float, v: float, k: int, fit: EnvironmentFit) -> float:
    """Two-sided tail of one environment's score of a binary trait, the score scaled to the variance of independent draws."""
    o = fit.seen[k]
    mu, x = fit.mean[k, o], fit.design[o]
    w = mu * (1 - mu)
    left = g[o] - x @ np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * g[o]))
    q = abs(u) * math.sqrt(float(w @ left**2) / v)
    return glm.saddlepoint(q, left, mu) + glm.saddlepoint(q, -left, mu)


def score(g: np.ndarray, state: tuple[EnvironmentFit, float]) -> dict[str, np.ndarray]:
    """Tests of columns; state: the fit, and the chi-square above which a binary trait's single environments use a saddlepoint."""
    fit, spa_above = state
    e, m = len(fit.residual), g.shape[1]
    u = (fit.residual @ g).T
    v = np.empty((m, e, e))
    if isinstance(fit.projection, thin.StackedProjection):
        v = np.moveaxis(fit.projection.forms(g), 2, 0)
    for a in range(0 if isinstance(fit.projection, np.ndarray) else e, e):
        for b in range(a, e):
            v[:, a, b] = v[:, b, a] = (g * (fit.projection[a, :, b] @ g)).sum(axis=0)
    own = np.diagonal(v, axis1=1, axis2=2)
    has = own > 1e-10
    chi2 = np.where(has, u * u / np.where(has, own, 1.0), np.nan)
    p_own = np.stack([_tail(chi2[:, k], 1) for k in range(e)], axis=1)
    if fit.family == "logit":
        for j, k in zip(*np.nonzero(np.nan_to_num(chi2) > spa_above), strict=True):
            tail = _saddlepoint(g[:, j], u[j, k], own[j, k], k, fit)
            if math.isfinite(tail) and 0 < tail <= 1:
                p_own[j, k] = max(tail, specfun.FLOOR)
    values = np.linalg.eigvalsh(v)
    ok = values[:, 0] > 1e-9 * np.maximum(values[:, -1], 1e-9)
    joint, alpha, se = np.full(m, np.nan), np.full(m, np.nan), np.full(m, np.nan)
    joint[ok] = np.einsum("mj,mj->m", u[ok], np.linalg.solve(v[ok], u[ok][:, :, None])[:, :, 0])
    info = v[ok].sum(axis=(1, 2))
    alpha[ok], se[ok] = u[ok].sum(axis=1) / info, 1 / np.sqrt(info)
    common = (alpha / se) ** 2
    inter = np.maximum(joint - common, 0.0)
    out = {"chi2": joint, "p": _tail(joint, e), "alpha": alpha, "se": se, "p_common": _tail(common, 1), "chi2_gxe": inter, "p_gxe": _tail(inter, e - 1) if e > 1 else np.full(m, np.nan)}
    for k in range(e):
        out |= {f"beta_e{k}": np.where(has[:, k], u[:, k] / np.where(has[:, k], own[:, k], 1.0), np.nan), f"p_e{k}": p_own[:, k]}
    return out


def scan(cells: DataFrame, fit: EnvironmentFit, spa_above: float = 2.0) -> DataFrame:
    """(v_idx, chi2, p, alpha, se, p_common, chi2_gxe, p_gxe, and beta_e0, p_e0 .. of the environments).

    A variant without variance in some environment has nulls in the joint tests.
    """
    if isinstance(fit.projection, thin.StackedProjection):
        fit = replace(fit, projection=fit.projection.compact())
    if fit.projection.nbytes > mixed.MOST_BYTES:
        raise ValueError(f"the projection of {len(fit.samples)} samples is too large to broadcast")
    singles = ", ".join(f"beta_e{k} double, p_e{k} double" for k in range(len(fit.residual)))
    return map_variants(cells, list(fit.samples), score, (fit, spa_above), f"chi2 double, p double, alpha double, se double, p_common double, chi2_gxe double, p_gxe double, {singles}")
