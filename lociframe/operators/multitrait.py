"""Mixed models of several traits or environments: covariance matrices on the driver, scans in Spark.

Y (samples x traits) = X B + U + E, cov(vec U) = Vg (x) K, cov(vec E) = Ve (x) I. In the eigenbasis
of K the samples are independent with covariance S_i = d_i Vg + Ve, so everything is sums over
samples of small matrices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lociframe.functions import specfun

from . import linalg, mixed, reml, thin
from .packed import map_variants


@dataclass(frozen=True)
class NullFit:
    """Fitted covariances and what the scan needs in the eigenbasis."""

    samples: tuple[int, ...]
    vectors: np.ndarray
    precision: np.ndarray  # (n, d, d), the inverses of S_i
    design: np.ndarray  # rotated
    residual: np.ndarray  # rotated Y - X B, (n, d)
    gram_inverse: np.ndarray  # of the (c d) normal equations
    vg: np.ndarray
    ve: np.ndarray
    beta: np.ndarray
    log_likelihood: float
    beyond: np.ndarray | None = None  # precision in the axes that the vectors leave out, where K, design and residual are 0


def precisions(values: np.ndarray, vg: np.ndarray, ve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and log determinant of d_i Vg + Ve for each eigenvalue, by diagonalising Vg against Ve once."""
    chol = np.linalg.cholesky(ve + 1e-10 * np.trace(ve) * np.eye(len(ve)))
    half = np.linalg.inv(chol)
    lam, q = np.linalg.eigh(half @ vg @ half.T)
    t = half.T @ q
    scale = 1 / (values[:, None] * np.maximum(lam, 0)[None] + 1)
    return np.einsum("ak,ik,bk->iab", t, scale, t), -np.log(scale).sum(axis=1) + 2 * np.log(np.diag(chol)).sum()


def _normal(y: np.ndarray, x: np.ndarray, precision: np.ndarray):
    c, d = x.shape[1], y.shape[1]
    gram = np.einsum("ia,ijk,ib->ajbk", x, precision, x).reshape(c * d, c * d)
    right = np.einsum("ia,ijk,ik->aj", x, precision, y).ravel()
    return gram, right, np.linalg.solve(gram, right).reshape(c, d)


def log_likelihood(vg: np.ndarray, ve: np.ndarray, y: np.ndarray, x: np.ndarray, values: np.ndarray, spare: int = 0) -> float:
    """REML log likelihood of rotated traits; ``spare`` axes have no genetic variance, traits or design."""
    precision, determinants = precisions(values, vg, ve)
    empty = spare * precisions(np.zeros(1), vg, ve)[1][0] if spare else 0.0
    gram, _, beta = _normal(y, x, precision)
    r = y - x @ beta
    n, d = y.shape
    return -0.5 * ((n + spare - x.shape[1]) * d * math.log(2 * math.pi) + determinants.sum() + empty + np.linalg.slogdet(gram)[1] + np.einsum("ij,ijk,ik->", r, precision, r))


def expectation_maximisation(y: np.ndarray, x: np.ndarray, values: np.ndarray, vg: np.ndarray, ve: np.ndarray, rounds: int = 100, tol: float = 1e-8, spare: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """REML steps of expectation maximisation over Vg and Ve, accelerated on their Cholesky factors."""
    n, d = y.shape
    live = values > 1e-12

    def step(v: np.ndarray) -> np.ndarray:
        a, e = _from_factors(v, d)
        precision, _ = precisions(values, a, e)
        gram, _, beta = _normal(y, x, precision)
        inverse = np.linalg.pinv(gram).reshape(x.shape[1], d, x.shape[1], d)
        px = np.einsum("ijk,ia->ijak", precision, x)
        shrink = precision - np.einsum("ijak,akbl,imbl->ijm", px, inverse, px, optimize=True)
        r = np.einsum("ijk,ik->ij", precision, y - x @ beta)
        u = values[:, None] * (r @ a)
        spread_u = values[:, None, None] * a - values[:, None, None] ** 2 * np.einsum("jk,ikl,lm->ijm", a, shrink, a)
        new_a = (np.einsum("ij,ik->ijk", u, u) + spread_u)[live] / values[live][:, None, None]
        eps = r @ e
        new_e = np.einsum("ij,ik->jk", eps, eps) + (e[None] - np.einsum("jk,ikl,lm->ijm", e, shrink, e)).sum(axis=0)
        return _factors(new_a.mean(axis=0), new_e / (n + spare))

    v, _ = reml.accelerated(step, _factors(vg, ve), rounds, tol)
    a, e = _from_factors(v, d)
    return a, e, log_likelihood(a, e, y, x, values, spare)


def _factors(vg: np.ndarray, ve: np.ndarray) -> np.ndarray:
    d = len(vg)
    at = np.tril_indices(d)
    parts = [np.linalg.cholesky((v + v.T) / 2 + 1e-9 * max(np.trace(v), 1e-9) * np.eye(d))[at] for v in (vg, ve)]
    return np.concatenate(parts)


def _from_factors(v: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    at, k, out = np.tril_indices(d), d * (d + 1) // 2, []
    for part in (v[:k], v[k:]):
        chol = np.zeros((d, d))
        chol[at] = part
        out.append(chol @ chol.T)
    return out[0], out[1] + 1e-10 * np.eye(d)


def _start(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    s = np.atleast_2d(r.T @ r / max(1, len(y) - x.shape[1]))
    return s / 2, s / 2


#: How Vg may look: any covariance, one without covariances, loadings on k factors plus a diagonal, or the product of one for traits and one for environments.
STRUCTURES = ("unstructured", "diagonal", "fa<k>", "separable")


def fit(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], structure: str = "unstructured", shape: tuple[int, int] | None = None, rounds: int = 200) -> NullFit:
    """REML of Vg and Ve by quasi-Newton steps on factors, from a few steps of expectation maximisation.

    ``shape`` is (traits, environments) of the columns for "separable", traits varying slowest.
    """
    values, vectors, spare = thin.axes(kinship, y, x)
    ry, rx = vectors.T @ y, vectors.T @ x
    d = y.shape[1]
    vg, ve = _start(y, x)
    vg, ve, _ = expectation_maximisation(ry, rx, values, vg, ve, rounds=5, spare=spare)
    at = np.tril_indices(d)
    k = len(at[0])

    def residual(v: np.ndarray) -> np.ndarray:
        chol = np.zeros((d, d))
        chol[at] = v
        return chol @ chol.T + 1e-9 * np.eye(d)

    if structure == "unstructured":
        start = _factors(vg, ve)
        unpack = lambda v: (residual(v[:k]), residual(v[k:]))
    elif structure == "diagonal":
        start = np.concatenate([np.log(np.maximum(np.diag(vg), 1e-8)), np.log(np.maximum(np.diag(ve), 1e-8))])
        unpack = lambda v: (np.diag(np.exp(v[:d])), np.diag(np.exp(v[d:])))
    elif structure.startswith("fa"):
        factors = int(structure[2:] or 1)
        lam, q = np.linalg.eigh(vg)
        loadings = q[:, -factors:] * np.sqrt(np.maximum(lam[-factors:], 1e-6))
        own = np.maximum(np.diag(vg) - (loadings**2).sum(axis=1), 1e-4 * np.trace(vg))
        start = np.concatenate([loadings.ravel(), np.log(own), _factors(vg, ve)[k:]])

        def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            load = v[: d * factors].reshape(d, factors)
            return load @ load.T + np.diag(np.exp(v[d * factors : d * factors + d])), residual(v[d * factors + d :])

    elif structure == "separable":
        traits, envs = shape
        t_at, e_at = np.tril_indices(traits), np.tril_indices(envs)
        blocks = vg.reshape(traits, envs, traits, envs)
        vt, vs = np.einsum("aebe->ab", blocks) / envs, np.einsum("aeaf->ef", blocks) / max(np.trace(vg) / envs, 1e-9)
        start = np.concatenate([np.linalg.cholesky(vt + 1e-6 * np.eye(traits))[t_at], np.linalg.cholesky(vs + 1e-6 * np.eye(envs))[e_at], _factors(vg, ve)[k:]])

        def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.zeros((traits, traits)), np.zeros((envs, envs))
            a[t_at], b[e_at] = v[: len(t_at[0])], v[len(t_at[0]) : len(t_at[0]) + len(e_at[0])]
            return np.kron(a @ a.T, b @ b.T), residual(v[len(t_at[0]) + len(e_at[0]) :])

    else:
        raise ValueError(f"unknown structure {structure}; one of {STRUCTURES}")

    def value(v: np.ndarray) -> float:
        try:
            return -log_likelihood(*unpack(v), ry, rx, values, spare)
        except np.linalg.LinAlgError:
            return math.inf

    found, _, _ = reml.minimise(value, start, rounds)
    vg, ve = unpack(found)
    return null_fit(y, x, values, vectors, samples, vg, ve)


def null_fit(y: np.ndarray, x: np.ndarray, values: np.ndarray, vectors: np.ndarray, samples: list[int], vg: np.ndarray, ve: np.ndarray) -> NullFit:
    """What the scan needs at given covariances."""
    ry, rx = vectors.T @ y, vectors.T @ x
    precision, _ = precisions(values, vg, ve)
    gram, _, beta = _normal(ry, rx, precision)
    spare = len(y) - len(values)
    beyond = precisions(np.zeros(1), vg, ve)[0][0] if spare else None
    return NullFit(tuple(samples), vectors, precision, rx, ry - rx @ beta, np.linalg.inv(gram), vg, ve, beta, log_likelihood(vg, ve, ry, rx, values, spare), beyond)


def _effects(g: np.ndarray, fit: NullFit) -> tuple[np.ndarray, np.ndarray]:
    """Effects (m, d) of columns on all traits and their information matrices, the design projected out."""
    rg = fit.vectors.T @ g
    d = fit.residual.shape[1]
    pr = np.einsum("ijk,ik->ij", fit.precision, fit.residual)
    u = rg.T @ pr
    info = np.einsum("im,ijk->mjk", rg * rg, fit.precision)
    if fit.beyond is not None:
        info = info + ((g * g).sum(axis=0) - (rg * rg).sum(axis=0))[:, None, None] * fit.beyond
    cross = np.einsum("im,ijk,ia->mjak", rg, fit.precision, fit.design).reshape(g.shape[1], d, -1)
    info = info - cross @ fit.gram_inverse @ np.swapaxes(cross, 1, 2)
    ok = np.linalg.eigvalsh(info)[:, 0] > 1e-10
    inverse = np.full_like(info, np.nan)
    inverse[ok] = np.linalg.inv(info[ok])
    return np.einsum("mjk,mk->mj", inverse, u), inverse


def _tail(stat: np.ndarray, df: float) -> np.ndarray:
    return np.where(np.isnan(stat), np.nan, np.clip(specfun.chi2_sf(np.nan_to_num(stat), df), specfun.FLOOR, 1))


def score(g: np.ndarray, fit: NullFit) -> dict[str, np.ndarray]:
    """Joint Wald test of a column's effects on all traits, and the effects."""
    beta, cov = _effects(g, fit)
    d = beta.shape[1]
    stat = np.full(len(beta), np.nan)
    ok = ~np.isnan(beta[:, 0])
    stat[ok] = np.einsum("mj,mjk,mk->m", beta[ok], np.linalg.inv(cov[ok]), beta[ok])
    out = {"stat": stat, "p": _tail(stat, float(d))}
    return out | {f"beta_d{k}": beta[:, k] for k in range(d)} | {f"se_d{k}": np.sqrt(cov[:, k, k]) for k in range(d)}


def scan(cells: DataFrame, fit: NullFit) -> DataFrame:
    """(v_idx, stat, p, beta_d0 .., se_d0 ..): the joint test of all traits."""
    d = fit.residual.shape[1]
    schema = ", ".join(["stat double", "p double", *(f"beta_d{k} double" for k in range(d)), *(f"se_d{k} double" for k in range(d))])
    return map_variants(cells, list(fit.samples), score, fit, schema)


def score_environments(g: np.ndarray, fit: NullFit) -> dict[str, np.ndarray]:
    """Mean effect over environments, and a Wald test that neighbouring environments' effects are equal."""
    beta, cov = _effects(g, fit)
    e = beta.shape[1]
    alpha, var = beta.mean(axis=1), cov.sum(axis=(1, 2)) / e**2
    main = alpha**2 / var
    c = np.eye(e)[:-1] - np.eye(e)[1:]
    d = beta @ c.T
    inter = np.full(len(beta), np.nan)
    ok = ~np.isnan(alpha)
    inter[ok] = np.einsum("mj,mjk,mk->m", d[ok], np.linalg.inv(np.einsum("aj,mjk,bk->mab", c, cov[ok], c)), d[ok])
    return {"alpha": alpha, "se": np.sqrt(var), "p_main": _tail(main, 1.0), "stat_gxe": inter, "p_gxe": _tail(inter, float(e - 1))}


def scan_environments(cells: DataFrame, fit: NullFit) -> DataFrame:
    """(v_idx, alpha, se, p_main, stat_gxe, p_gxe): columns of the traits are environments."""
    return map_variants(cells, list(fit.samples), score_environments, fit, "alpha double, se double, p_main double, stat_gxe double, p_gxe double")


def random_regression(y: np.ndarray, times: np.ndarray, order: int = 1) -> np.ndarray:
    """Each sample's coefficients on normalised Legendre polynomials of standardised time; (samples x times) to (samples x order + 1). They are traits of `fit`."""
    basis = linalg.legendre(linalg.standardised_time(times, times.min(), times.max()), order)
    if len(times) < order + 1:
        raise ValueError("fewer times than coefficients")
    return np.linalg.lstsq(basis, y.T, rcond=None)[0].T


# One trait, several kernels.


@dataclass(frozen=True)
class KernelFit:
    """A dense projection of a model with several kernels."""

    samples: tuple[int, ...]
    projection: np.ndarray
    py: np.ndarray
    variances: np.ndarray
    log_likelihood: float
    df: int


def fit_kernels(y: np.ndarray, x: np.ndarray, kernels: list[np.ndarray], samples: list[int]) -> KernelFit:
    """Average-information REML of one variance for each kernel (additive, dominance, epistatic, environments' own ...)."""
    if all(isinstance(k, thin.Thin) for k in kernels):
        s, ll, py, p = thin.average_information(y, x, kernels, [])
        return KernelFit(tuple(samples), p, py, s, ll, len(y) - x.shape[1] - 1)
    s, ll, inverse = reml.average_information(y, x, [k.dense() if isinstance(k, thin.Thin) else k for k in kernels])
    vx = inverse @ x
    p = inverse - vx @ np.linalg.solve(x.T @ vx, vx.T)
    return KernelFit(tuple(samples), p, p @ y, s, ll, len(y) - x.shape[1] - 1)


def score_kernels(g: np.ndarray, fit: KernelFit) -> dict[str, np.ndarray]:
    u, info = g.T @ fit.py, (g * (fit.projection @ g)).sum(axis=0)
    ok = info > 1e-10
    info = np.where(ok, info, 1.0)
    beta, se = np.where(ok, u / info, np.nan), np.where(ok, 1 / np.sqrt(info), np.nan)
    return {"beta": beta, "se": se, "p": _tail((beta / se) ** 2, 1.0)}


def scan_kernels(cells: DataFrame, fit: KernelFit) -> DataFrame:
    if fit.projection.nbytes > mixed.MOST_BYTES:
        raise ValueError(f"the projection of {len(fit.samples)} samples is too large to broadcast")
    return map_variants(cells, list(fit.samples), score_kernels, fit, "beta double, se double, p double")


def interaction_kernels(kinship: np.ndarray, env: np.ndarray, levels: bool = False) -> list[np.ndarray]:
    """K, and K times the similarity of environments: the product of covariates, or 1 within a level."""
    if isinstance(kinship, thin.Thin):
        columns = [(env == e).astype(float) for e in np.unique(env)] if levels else [env]
        return [kinship, thin.Thin(np.column_stack([c[:, None] * kinship.factor for c in columns]))]
    near = (env[:, None] == env[None]).astype(float) if levels else np.outer(env, env)
    return [kinship, kinship * near]


def fit_heteroscedastic(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, env: np.ndarray, samples: list[int]) -> KernelFit:
    """One genetic variance and a residual variance of its own for each environment."""
    if isinstance(kinship, thin.Thin):
        s, ll, py, p = thin.average_information(y, x, [kinship], [env == e for e in np.unique(env)[:-1]])
        return KernelFit(tuple(samples), p, py, s, ll, len(y) - x.shape[1] - 1)
    flags = [np.diag((env == e).astype(float)) for e in np.unique(env)]
    # the last environment's residual is the model's own identity part
    return fit_kernels(y, x, [kinship, *flags[:-1]], samples)


def score_gxe(g: np.ndarray, state: tuple[KernelFit, np.ndarray]) -> dict[str, np.ndarray]:
    """Main effect given interaction, interaction, and both: F tests on the projection of a null fit. State: the fit and the covariate."""
    fit, z = state
    a, b = g, g * z[:, None]
    pa, pb = fit.projection @ a, fit.projection @ b
    aa, bb, ab, ay, by = (a * pa).sum(0), (b * pb).sum(0), (a * pb).sum(0), a.T @ fit.py, b.T @ fit.py
    det = aa * bb - ab * ab
    ok = det > 1e-9
    det = np.where(ok, det, 1.0)
    main, inter = (bb * ay - ab * by) / det, (aa * by - ab * ay) / det
    keep = lambda v: np.where(ok, v, np.nan)
    f = lambda stat, df: keep(specfun.f_sf(np.where(ok, stat, 0.0), df, float(fit.df - 1)))
    joint = (main * ay + inter * by) / 2
    return {"beta_main": keep(main), "beta_interact": keep(inter), "p_main": f(main**2 * det / bb, 1.0), "p_interact": f(inter**2 * det / aa, 1.0), "p_joint": f(joint, 2.0)}


def scan_gxe(cells: DataFrame, fit: KernelFit, z: np.ndarray) -> DataFrame:
    """(v_idx, beta_main, beta_interact, p_main, p_interact, p_joint) under a mixed model with a genetic interaction kernel."""
    return map_variants(cells, list(fit.samples), score_gxe, (fit, z), "beta_main double, beta_interact double, p_main double, p_interact double, p_joint double")


# What a fit says about its traits.


def genetic_correlation(vg: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(vg), 1e-300))
    return vg / sd[:, None] / sd[None]


def heritabilities(fit: NullFit) -> np.ndarray:
    """Genetic share of each trait's or environment's variance, at a mean relationship of one."""
    g, e = np.diag(fit.vg), np.diag(fit.ve)
    return g / np.maximum(g + e, 1e-300)


def loadings(vg: np.ndarray, factors: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Leading factor loadings of a covariance and what they leave on the diagonal."""
    values, vectors = np.linalg.eigh(vg)
    load = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors], 0))
    return load * np.sign(load.sum(axis=0)), np.maximum(np.diag(vg) - (load**2).sum(axis=1), 0)


def interaction_share(vg: np.ndarray) -> float:
    """Share of the genetic variance that is not common to all environments: one less the mean covariance over the mean variance."""
    e = len(vg)
    common = (vg.sum() - np.trace(vg)) / max(e * (e - 1), 1)
    return float(np.clip(1 - common / max(np.trace(vg) / e, 1e-300), 0, 1))


def stability(vg: np.ndarray) -> np.ndarray:
    """Mean genetic correlation of each environment with the others."""
    r = genetic_correlation(vg)
    return (r.sum(axis=1) - 1) / max(len(vg) - 1, 1)


def by_trait_and_environment(fit: NullFit, traits: int, envs: int) -> dict[str, np.ndarray]:
    """Correlations of traits and of environments from a separable covariance, and heritabilities (traits x environments)."""
    a, b = linalg.nearest_kronecker(fit.vg, traits, envs)
    return {"traits": genetic_correlation(a), "environments": genetic_correlation(b), "heritability": heritabilities(fit).reshape(traits, envs)}


def resume(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, fit: NullFit, rounds: int = 200) -> NullFit:
    """Continue a fit from its covariances, for other traits or designs of the same samples."""
    values, vectors, spare = thin.axes(kinship, y, x)
    ry, rx = vectors.T @ y, vectors.T @ x
    d = y.shape[1]
    k = d * (d + 1) // 2

    def value(v: np.ndarray) -> float:
        try:
            return -log_likelihood(*_from_factors(v, d), ry, rx, values, spare)
        except np.linalg.LinAlgError:
            return math.inf

    found, _, _ = reml.minimise(value, _factors(fit.vg, fit.ve)[: 2 * k], rounds)
    return null_fit(y, x, values, vectors, list(fit.samples), *_from_factors(found, d))


def kernel_tests(y: np.ndarray, x: np.ndarray, kernels: list[np.ndarray], samples: list[int]) -> list[tuple[float, float]]:
    """(statistic, p) of each kernel's variance by the likelihood ratio without it; the null is on the boundary, so half a chi-square."""
    whole = fit_kernels(y, x, kernels, samples).log_likelihood
    out = []
    for k in range(len(kernels)):
        rest = kernels[:k] + kernels[k + 1 :]
        if rest:
            null = fit_kernels(y, x, rest, samples).log_likelihood
        else:
            n, c = x.shape
            r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            s2 = float(r @ r) / (n - c)
            null = -0.5 * ((n - c) * math.log(2 * math.pi * s2) + np.linalg.slogdet(x.T @ x)[1] + (n - c))
        stat = max(2 * (whole - null), 0.0)
        out.append((stat, 0.5 * float(specfun.chi2_sf(stat, 1.0)) if stat > 0 else 1.0))
    return out


# Curves of a random regression: coefficients' covariances seen along time.


def curves(fit: NullFit, times: np.ndarray, low: float, high: float) -> dict[str, np.ndarray]:
    """Genetic and residual variance, heritability, and genetic correlation between times; the traits of the fit are Legendre coefficients."""
    basis = linalg.legendre(linalg.standardised_time(times, low, high), len(fit.vg) - 1)
    g, e = basis @ fit.vg @ basis.T, basis @ fit.ve @ basis.T
    return {"genetic": np.diag(g), "residual": np.diag(e), "heritability": np.diag(g) / np.maximum(np.diag(g) + np.diag(e), 1e-300), "correlation": genetic_correlation(g)}


def eigenfunctions(fit: NullFit, times: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the genetic variance of its axes, and each axis as a curve over time."""
    values, vectors = np.linalg.eigh(fit.vg)
    order = np.argsort(values)[::-1]
    basis = linalg.legendre(linalg.standardised_time(times, low, high), len(fit.vg) - 1)
    return np.maximum(values[order], 0) / max(values.sum(), 1e-300), basis @ vectors[:, order]


def spatial_trend(y: np.ndarray, rows: np.ndarray, columns: np.ndarray, knots: int = 5, degree: int = 3) -> tuple[np.ndarray, float]:
    """The smooth trend of a field by penalised splines in both directions, its smoothness by generalised cross-validation; (trend, smoothness)."""
    basis, a, b = linalg.surface(np.asarray(rows, float), np.asarray(columns, float), knots, knots, degree)
    gram, right, n = basis.T @ basis, basis.T @ (y - y.mean()), len(y)

    def at(weight: float) -> tuple[float, np.ndarray]:
        inverse = np.linalg.inv(gram + weight * (a + b) + 1e-8 * np.eye(len(gram)))
        fitted = basis @ (inverse @ right)
        df = float(np.trace(inverse @ gram))
        return float(((y - y.mean() - fitted) ** 2).sum()) / n / max(1 - df / n, 1e-6) ** 2, fitted

    grid = np.exp(np.linspace(-6, 10, 33))
    best = min(grid, key=lambda w: at(w)[0])
    return at(best)[1] + y.mean(), float(best)


def wide_traits(rows: DataFrame, who: str, env: str, value: str, complete: bool = True) -> tuple[list, list, np.ndarray]:
    """(samples, environments, matrix) of long traits; with ``complete`` only samples with all of them."""
    from pyspark.sql import functions as F

    envs = [r[0] for r in rows.select(env).distinct().orderBy(env).collect()]
    wide = rows.groupBy(who).pivot(env, envs).agg(F.avg(value))
    table = (wide.dropna() if complete else wide).orderBy(who).toPandas()
    return table[who].tolist(), envs, table[[str(e) for e in envs]].to_numpy(float)
