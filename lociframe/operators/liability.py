"""Ordered traits beside linear ones: liabilities with thresholds, jointly with continuous traits; scores scanned in Spark.

    l_i = X_i b + u_i + e_i,   cov(u) = Vg x K,   e_i ~ N(0, Ve)

An ordered trait is seen as the interval its liability lies in, a continuous one as itself. Vg and Ve are
given, or taken by `components` from a linear model of normal scores. The null model is the mode over (b, u):
Newton steps on the scores s_i = Ve^-1 (E[l_i | seen] - mean_i) and informations Ve^-1 - Ve^-1 Cov[l_i | seen] Ve^-1,
halved until the objective, which is concave, rises. Moments within limits are exact up to quadrature.

Defined cases: a NaN is unseen, in any column; a sample without any value adds nothing. Categories are
0, 1, .. in order. Without given thresholds they are quantiles at the liability's total variance.

Scale: dense over samples times traits, checked against `mixed.MOST_BYTES`; the scan streams packed variants.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lociframe.functions import specfun

from . import env_curves, linalg, mixed, multitrait, thin
from .env_curves import Stacked
from .packed import map_variants

#: Points of the quadrature in each liability but the last, and the most liabilities together.
POINTS, MOST_ORDINAL = 64, 3


@dataclass(frozen=True)
class LiabilityFit:
    """A null fit: expected liabilities and effects (design x traits), and what the scan needs."""

    samples: tuple
    thresholds: tuple[np.ndarray, ...]
    vg: np.ndarray
    ve: np.ndarray
    beta: np.ndarray
    liabilities: np.ndarray
    objective: float
    settled: bool
    inner: Stacked


def block_moments(mean: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean (n, k), covariance (n, k, k) and log probability of normal vectors with one covariance, each within its own limits.

    One element after the other is integrated within what the ones before leave it; the last one is exact.
    """
    n, k = mean.shape
    if k > MOST_ORDINAL:
        raise ValueError(f"{k} ordered traits together are too many; at most {MOST_ORDINAL}")
    chol = np.linalg.cholesky(cov)
    t, w = np.polynomial.legendre.leggauss(POINTS)
    z, weight = np.zeros((n, 1, 0)), np.ones((n, 1))
    for j in range(k - 1):
        shift = mean[:, [j]] + z @ chol[j, :j]
        a, b = (low[:, [j]] - shift) / chol[j, j], (high[:, [j]] - shift) / chol[j, j]
        # nothing to speak of lies beyond nine deviations, or six further out than a limit in a tail
        left = np.where(b < -6, np.maximum(a, b - 6), np.clip(a, -9, None))
        right = np.where(a > 6, np.minimum(b, a + 6), np.clip(b, None, 9))
        half = np.maximum(right - left, 0) / 2
        node = (left + half)[:, :, None] + half[:, :, None] * t
        weight = (weight[:, :, None] * half[:, :, None] * w * specfun.norm_pdf(node)).reshape(n, -1)
        z = np.concatenate([np.repeat(z, POINTS, axis=1), node.reshape(n, -1, 1)], axis=2)
    shift = mean[:, [k - 1]] + z @ chol[k - 1, : k - 1]
    a, b = (low[:, [k - 1]] - shift) / chol[-1, -1], (high[:, [k - 1]] - shift) / chol[-1, -1]
    first, spread = linalg.truncated_moments(0.0, 1.0, a, b)
    turned = a > 0
    mass = specfun.norm_cdf(np.where(turned, -a, b)) - specfun.norm_cdf(np.where(turned, -b, a))
    weight = weight * np.maximum(mass, 1e-300)
    total = np.maximum(weight.sum(axis=1), 1e-300)
    weight = weight / total[:, None]
    z = np.concatenate([z, first[:, :, None]], axis=2)
    centre = np.einsum("nq,nqj->nj", weight, z)
    apart = z - centre[:, None, :]
    second = np.einsum("nq,nqi,nqj->nij", weight, apart, apart)
    second[:, -1, -1] += (weight * spread).sum(axis=1)
    return mean + centre @ chol.T, chol @ second @ chol.T, np.log(total)


def moments(y: np.ndarray, ordinal: list[int], thresholds: tuple[np.ndarray, ...], mean: np.ndarray, ve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and covariance of each sample's liabilities given what is seen of it, and the log likelihood of that."""
    n, d = y.shape
    c, linear = np.array(ordinal, int), np.array([k for k in range(d) if k not in ordinal], int)
    low, high = np.full((n, len(c)), -np.inf), np.full((n, len(c)), np.inf)
    for j, (k, cuts) in enumerate(zip(c, thresholds, strict=True)):
        seen = ~np.isnan(y[:, k])
        level, ends = y[seen, k].astype(int), np.concatenate([[-np.inf], cuts, [np.inf]])
        low[seen, j], high[seen, j] = ends[level], ends[level + 1]
    expected, spread, likelihood = mean.copy(), np.zeros((n, d, d)), np.zeros(n)
    patterns, which = np.unique(~np.isnan(y[:, linear]), axis=0, return_inverse=True)
    for p, pattern in enumerate(patterns):
        rows = np.flatnonzero(which.ravel() == p)
        o, m = linear[pattern], linear[~pattern]
        left = y[np.ix_(rows, o)] - mean[np.ix_(rows, o)]
        own = np.linalg.inv(ve[np.ix_(o, o)])
        if len(o):
            likelihood[rows] += -0.5 * (np.einsum("ij,jk,ik->i", left, own, left) + np.linalg.slogdet(ve[np.ix_(o, o)])[1] + len(o) * math.log(2 * math.pi))
            expected[np.ix_(rows, o)] = y[np.ix_(rows, o)]
        if len(c):
            given = ve[np.ix_(c, o)] @ own
            found, cov, mass = block_moments(mean[np.ix_(rows, c)] + left @ given.T, ve[np.ix_(c, c)] - given @ ve[np.ix_(o, c)], low[rows], high[rows])
            likelihood[rows] += mass
            expected[np.ix_(rows, c)] = found
            spread[np.ix_(rows, c, c)] = cov
        if len(m):
            rest = np.concatenate([c, o])
            by = ve[np.ix_(m, rest)] @ np.linalg.inv(ve[np.ix_(rest, rest)])
            expected[np.ix_(rows, m)] = mean[np.ix_(rows, m)] + (expected[np.ix_(rows, rest)] - mean[np.ix_(rows, rest)]) @ by.T
            at = spread[np.ix_(rows, rest, rest)]
            spread[np.ix_(rows, m, m)] = ve[np.ix_(m, m)] - by @ ve[np.ix_(rest, m)] + by @ at @ by.T
            spread[np.ix_(rows, m, rest)], spread[np.ix_(rows, rest, m)] = by @ at, at @ by.T
    return expected, spread, likelihood


def quantile_thresholds(level: np.ndarray, sd: float) -> np.ndarray:
    level = level[~np.isnan(level)].astype(int)
    shares = np.array([(level <= j).mean() for j in range(level.max())]) if len(level) else np.zeros(0)
    return sd * specfun.norm_ppf(np.clip(shares, 1e-6, 1 - 1e-6))


def components(y: np.ndarray, ordinal: list[int], x: np.ndarray, kinship: np.ndarray, samples: list) -> tuple[np.ndarray, np.ndarray]:
    """(Vg, Ve) of a linear model where an ordered trait is the mean of a normal variable in its category, scaled to a residual variance of 1; samples with all traits."""
    own = ~np.isnan(y).any(axis=1)
    scored = y[own].copy()
    for k in ordinal:
        ends = np.concatenate([[-np.inf], quantile_thresholds(y[own, k], 1.0), [np.inf]])
        middle = linalg.truncated_moments(0.0, 1.0, ends[:-1], ends[1:])[0]
        scored[:, k] = middle[y[own, k].astype(int)]
    near = kinship.of(own) if isinstance(kinship, thin.Thin) else kinship[np.ix_(own, own)]
    found = multitrait.fit(scored, x[own], near, [s for s, o in zip(samples, own, strict=True) if o])
    scale = np.array([1 / math.sqrt(found.ve[k, k]) if k in ordinal else 1.0 for k in range(y.shape[1])])
    return found.vg * np.outer(scale, scale), found.ve * np.outer(scale, scale)


def fit(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list, ordinal: list[int], vg: np.ndarray | None = None, ve: np.ndarray | None = None, thresholds: list[np.ndarray] | None = None, rounds: int = 100, tol: float = 1e-9) -> LiabilityFit:
    """Null model of y (samples x traits, NaN where unseen); x has an intercept, ``ordinal`` says which columns are ordered."""
    n, d = y.shape
    factored = isinstance(kinship, thin.Thin)
    if not factored and (n * d) ** 2 * 32 > mixed.MOST_BYTES:
        raise ValueError(f"{n} samples of {d} traits are too many for a dense fit")
    for k in ordinal:
        seen = y[~np.isnan(y[:, k]), k]
        if (seen != np.floor(seen)).any() or (seen < 0).any():
            raise ValueError("categories of an ordered trait are 0, 1, ..")
    if vg is None or ve is None:
        vg, ve = components(y, ordinal, x, kinship, samples)
    vg, ve = np.asarray(vg, float), np.asarray(ve, float)
    if thresholds is None:
        level = (kinship.factor**2).sum() / n if factored else np.diag(kinship).mean()
        thresholds = [quantile_thresholds(y[:, k], math.sqrt(ve[k, k] + vg[k, k] * level)) for k in ordinal]
    for k, cuts in zip(ordinal, thresholds, strict=True):
        if (~np.isnan(y[:, k])).any() and np.nanmax(y[:, k]) > len(cuts):
            raise ValueError("an ordered trait has more categories than its thresholds make")
    thresholds = tuple(np.asarray(t, float) for t in thresholds)
    inverse = np.linalg.inv(ve)
    spread_u = lambda r: vg @ (r @ kinship.factor) @ kinship.factor.T if factored else vg @ r @ kinship  # noqa: E731  of (d, n)

    def at(beta: np.ndarray, r: np.ndarray):
        u = spread_u(r)
        mean = x @ beta + u.T
        expected, cov, likelihood = moments(y, ordinal, thresholds, mean, ve)
        return likelihood.sum() - 0.5 * float((r * u).sum()), mean, expected, cov

    def newton(mean: np.ndarray, expected: np.ndarray, cov: np.ndarray):
        s = (expected - mean) @ inverse
        lam, q = np.linalg.eigh(inverse - inverse @ cov @ inverse)
        root = np.sqrt(np.where(lam > 1e-12 * np.abs(lam).max(), np.maximum(lam, 0), 0.0))
        if factored:
            weights = np.einsum("iab,ib,icb->aci", q, root**2, q)
            seen = np.einsum("iab,ib,icb,ic->ai", q, (root > 0).astype(float), q, s)
            found = thin.solve(weights, np.einsum("abi,ib->ai", weights, mean) + seen, x, kinship, vg)
            return s, found.projection, found.beta.T, found.r
        half = np.einsum("iab,ib,icb->iac", q, root, q)
        back = np.einsum("iab,ib,icb->iac", q, np.where(root > 0, 1 / np.where(root > 0, root, 1.0), 0.0), q)
        mid = np.einsum("ita,ab,jbs->tisj", half, vg, half, optimize=True) * kinship[None, :, None, :]
        core = np.linalg.inv(np.eye(d * n) + mid.reshape(d * n, d * n))
        hx = np.einsum("its,ic->tisc", half, x).reshape(d * n, -1)
        gram = np.linalg.pinv(hx.T @ core @ hx)
        hz = (np.einsum("its,is->ti", half, mean) + np.einsum("its,is->ti", back, s)).ravel()
        beta = gram @ (hx.T @ (core @ hz))
        r = np.einsum("its,si->ti", half, (core @ (hz - hx @ beta)).reshape(d, n))
        ch = core @ hx
        p = lambda: np.einsum("iat,tisj,jsb->aibj", half, (core - ch @ gram @ ch.T).reshape(d, n, d, n), half, optimize=True)
        return s, p, beta.reshape(d, -1).T, r

    beta, r, settled = np.zeros((x.shape[1], d)), np.zeros((d, n)), False
    for k in range(d):
        seen = ~np.isnan(y[:, k])
        if k not in ordinal and seen.any():
            beta[:, k] = np.linalg.lstsq(x[seen], y[seen, k], rcond=None)[0]
    best, mean, expected, cov = at(beta, r)
    for _ in range(rounds):
        _, _, new_beta, new_r = newton(mean, expected, cov)
        step = 1.0
        while step > 1e-6:
            b, v = beta + step * (new_beta - beta), r + step * (new_r - r)
            found = at(b, v)
            if found[0] >= best - 1e-9 * abs(best):
                break
            step /= 2
        moved = np.abs(found[1] - mean).max()
        beta, r, (best, mean, expected, cov) = b, v, found
        if moved < tol * (1 + np.abs(mean).max()):
            settled = True
            break
    if not settled:
        warnings.warn(f"the null fit had not settled after {rounds} rounds", stacklevel=2)
    s, p, _, _ = newton(mean, expected, cov)
    projection = p if factored else p()
    return LiabilityFit(tuple(samples), thresholds, vg, ve, beta, expected, float(best), settled, Stacked(s.T.copy(), projection))


def score(g: np.ndarray, fit: LiabilityFit) -> dict[str, np.ndarray]:
    """Joint score test of a column on all liabilities and of each alone, and the effects of one step on all together."""
    beta, cov = env_curves._effects(g, fit)
    ok, d = ~np.isnan(beta[:, 0]), beta.shape[1]
    tail = lambda stat, df: np.where(np.isnan(stat), np.nan, np.clip(specfun.chi2_sf(np.nan_to_num(stat), float(df)), specfun.FLOOR, 1))
    info = np.full_like(cov, np.nan)
    info[ok] = np.linalg.inv(cov[ok])
    u = np.einsum("mij,mj->mi", info, beta)
    joint = (u * beta).sum(axis=1)
    out = {"stat": joint, "p": tail(joint, d)}
    for k in range(d):
        own = u[:, k] ** 2 / info[:, k, k]
        out |= {f"stat_d{k}": own, f"p_d{k}": tail(own, 1), f"beta_d{k}": beta[:, k], f"se_d{k}": np.sqrt(cov[:, k, k])}
    return out


def scan(cells: DataFrame, fit: LiabilityFit) -> DataFrame:
    """(v_idx, stat, p, and stat_d0, p_d0, beta_d0, se_d0 .. of the traits); NaN for a variant without variance in what is seen."""
    if fit.inner.projection.nbytes > mixed.MOST_BYTES:
        raise ValueError(f"the projection of {len(fit.samples)} samples is too large to broadcast")
    names = ["stat", "p", *(f"{n}_d{k}" for k in range(len(fit.ve)) for n in ("stat", "p", "beta", "se"))]
    return map_variants(cells, list(fit.samples), score, fit, ", ".join(f"{n} double" for n in names))
