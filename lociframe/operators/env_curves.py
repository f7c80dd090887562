"""Traits over time in several environments: curves by sample and environment, their covariance, tests of a variant's curves.

A sample's measures in one environment become coefficients on a basis of time (Legendre polynomials or
B-splines), which all environments share: its range or knots come from the pooled times, so a
coefficient means the same everywhere. Coefficients in environments are the traits, coefficients varying
slowest, of a mixed model

    cov(u) = sum_j Sigma_j x K_j + Ve x I,   Sigma_j = A_j x B_j where separable.

One kernel and samples seen in every environment go through the eigenbasis of `multitrait`. Several kernels
or unseen environments go through the stacked rows that were seen, with exact derivatives.

Defined cases: rows with a null or NaN sample, environment, time or value are left out; repeated rows are
further measures. A sample with too few distinct times in an environment has null coefficients there and
counts as unseen. One time only makes every standardised time zero. An empty table has no coefficients.

Scale: coefficients are one aggregation of basis products, combined before the shuffle. The stacked fit is
dense and checked against `mixed.MOST_BYTES`; scans stream packed variants against what it leaves.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import linalg, mixed, multitrait, reml, thin
from .packed import map_variants


@dataclass(frozen=True)
class Basis:
    """A basis of time: Legendre polynomials up to an order on [low, high], or B-splines on knots."""

    kind: str
    low: float
    high: float
    order: int = 1
    knots: tuple[float, ...] = ()
    degree: int = 3

    @property
    def size(self) -> int:
        return self.order + 1 if self.kind == "legendre" else len(self.knots) + self.degree - 1

    def values(self, times: np.ndarray) -> np.ndarray:
        if self.kind == "legendre":
            return linalg.basis_at(np.asarray(times, float), "legendre", low=self.low, high=self.high, order=self.order)
        return linalg.basis_at(np.asarray(times, float), "bspline", knots=np.array(self.knots), degree=self.degree)

    def columns(self, time: Column) -> list[Column]:
        """The basis at a column of times, as built-in expressions."""
        if self.kind == "legendre":
            t = (time - F.lit(self.low)) * F.lit(2 / (self.high - self.low)) - 1 if self.high > self.low else F.lit(0.0)
            plain = [F.lit(1.0), t]
            for k in range(1, self.order):
                plain.append((t * plain[k] * (2 * k + 1) - plain[k - 1] * k) / (k + 1))
            return [p * math.sqrt((2 * k + 1) / 2) for k, p in enumerate(plain[: self.order + 1])]
        u = [self.knots[0]] * self.degree + list(self.knots) + [self.knots[-1]] * self.degree
        last = max(i for i in range(len(u) - 1) if u[i] < u[i + 1])
        step = [((time >= u[i]) & ((time <= u[i + 1]) if i == last else (time < u[i + 1]))).cast("double") if u[i] < u[i + 1] else F.lit(0.0) for i in range(len(u) - 1)]
        for d in range(1, self.degree + 1):
            up = lambda i, d=d: (time - u[i]) / (u[i + d] - u[i]) if u[i + d] > u[i] else F.lit(0.0)
            step = [up(i) * step[i] + (F.lit(1.0) - up(i + 1) if u[i + d + 1] > u[i + 1] else F.lit(0.0)) * step[i + 1] for i in range(len(step) - 1)]
        return step


def _measured(rows: DataFrame, who: str, env: str, time: str, value: str) -> DataFrame:
    own = rows.select(F.col(who).alias("who"), F.col(env).alias("env"), F.col(time).cast("double").alias("time"), F.col(value).cast("double").alias("value"))
    return own.where("who is not null and env is not null and time is not null and value is not null and not isnan(time) and not isnan(value)")


def pooled_basis(rows: DataFrame, time: str, kind: str = "legendre", order: int = 1, interior: int = 4, degree: int = 3, knots: str = "quantile") -> Basis:
    """The basis of the pooled times of all environments; quantile knots are exact and hold a count for each distinct time."""
    if kind not in ("legendre", "bspline") or order < 0 or interior < 0:
        raise ValueError("a basis is legendre with an order, or bspline with interior knots, of 0 or more")
    shares = [float(s) for s in np.linspace(0, 1, interior + 2)]
    t = F.col(time).cast("double")
    wanted = [F.min(t), F.max(t), *([F.percentile(t, F.array(*map(F.lit, shares)))] if kind == "bspline" and knots == "quantile" else [])]
    found = rows.where(t.isNotNull() & ~F.isnan(t)).agg(*wanted).first()
    low, high = (0.0, 0.0) if found[0] is None else (found[0], found[1])
    if kind == "legendre":
        return Basis(kind, low, high, order)
    inner = found[2] or [0.0] * len(shares) if knots == "quantile" else [low + s * (high - low) for s in shares]
    if high <= low:
        raise ValueError("splines need times that differ")
    return Basis(kind, low, high, knots=tuple(inner), degree=degree)


def project(rows: DataFrame, basis: Basis, who: str, env: str, time: str, value: str) -> DataFrame:
    """(who, env, n_obs, coefficients): least squares of each sample's measures in each environment."""
    b = basis.size
    at = basis.columns(F.col("time"))
    wide = _measured(rows, who, env, time, value).select("who", "env", "value", *(c.alias(f"phi{k}") for k, c in enumerate(at)))
    pairs = [(j, k) for j in range(b) for k in range(j, b)]
    sums = wide.groupBy("who", "env").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.array(*(F.sum(F.col(f"phi{j}") * F.col(f"phi{k}")) for j, k in pairs)).alias("gram"),
        F.array(*(F.sum(F.col(f"phi{k}") * F.col("value")) for k in range(b))).alias("right"),
    )

    def solved(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            gram, right = np.zeros((len(part), b, b)), np.array(part["right"].tolist(), float).reshape(-1, b)
            for (j, k), column in zip(pairs, np.array(part["gram"].tolist(), float).reshape(-1, len(pairs)).T, strict=True):
                gram[:, j, k] = gram[:, k, j] = column
            spread = np.linalg.eigvalsh(gram)
            ok = spread[:, 0] > 1e-12 * spread[:, -1]
            found = np.linalg.solve(gram[ok], right[ok][:, :, None])[:, :, 0]
            out = np.full(len(part), None, object)
            for i, row in zip(np.flatnonzero(ok), found, strict=True):
                out[i] = row
            yield pd.DataFrame({"who": part["who"], "env": part["env"], "n_obs": part["n_obs"], "coefficients": out})

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(solved, f"who {kinds['who']}, env {kinds['env']}, n_obs long, coefficients array<double>")


def traits(projected: DataFrame, samples: list, environments: list, size: int) -> np.ndarray:
    """(samples, size * environments), column k * environments + e; NaN where unseen. At most `mixed.MOST_BYTES`."""
    if len(samples) * size * len(environments) * 8 > mixed.MOST_BYTES:
        raise ValueError(f"{len(samples)} samples are too many for the driver")
    place, env_place, e = {s: i for i, s in enumerate(samples)}, {v: i for i, v in enumerate(environments)}, len(environments)
    y = np.full((len(samples), size, e), np.nan)
    for row in projected.where("coefficients is not null").toLocalIterator():
        if row["who"] in place and row["env"] in env_place:
            y[place[row["who"]], :, env_place[row["env"]]] = row["coefficients"]
    return y.reshape(len(samples), size * e)


# Covariances by structure: parameters, what they stand for, and the derivative by them from that by the covariance.


def _lower(v: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.tril_indices(d)] = v
    return out


def _structure(name: str, size: int, envs: int, start: np.ndarray) -> tuple[np.ndarray, Callable, Callable]:
    """(start, covariance of parameters, slope of parameters given G), where the objective moves by <G, d covariance> / 2."""
    d = size * envs
    if name == "unstructured":
        at = np.tril_indices(d)
        return np.linalg.cholesky(start)[at], lambda v: _lower(v, d) @ _lower(v, d).T, lambda v, g: (g @ _lower(v, d))[at]
    if name == "diagonal":
        return np.log(np.diag(start)), lambda v: np.diag(np.exp(v)), lambda v, g: 0.5 * np.diag(g) * np.exp(v)
    if name == "separable":
        k = size * (size + 1) // 2
        at, bt = np.tril_indices(size), np.tril_indices(envs)
        a, b = linalg.nearest_kronecker(start, size, envs)
        first = [np.linalg.cholesky(linalg.symmetric(m) * np.sign(np.trace(m)) + 1e-3 * abs(np.trace(m)) * np.eye(len(m))) for m in (a, b)]

        def slope(v: np.ndarray, g: np.ndarray) -> np.ndarray:
            la, lb, blocks = _lower(v[:k], size), _lower(v[k:], envs), g.reshape(size, envs, size, envs)
            return np.concatenate([(np.einsum("aebf,ef->ab", blocks, lb @ lb.T) @ la)[at], (np.einsum("aebf,ab->ef", blocks, la @ la.T) @ lb)[bt]])

        return np.concatenate([first[0][at], first[1][bt]]), lambda v: np.kron(_lower(v[:k], size) @ _lower(v[:k], size).T, _lower(v[k:], envs) @ _lower(v[k:], envs).T), slope
    if name.startswith("fa"):
        f = int(name[2:] or 1)
        lam, q = np.linalg.eigh(start)
        load = q[:, -f:] * np.sqrt(np.maximum(lam[-f:], 1e-6))
        own = np.maximum(np.diag(start) - (load**2).sum(axis=1), 0.05 * np.diag(start))
        split = lambda v: (v[: d * f].reshape(d, f), np.exp(v[d * f :]))
        return (
            np.concatenate([load.ravel(), np.log(own)]),
            lambda v: split(v)[0] @ split(v)[0].T + np.diag(split(v)[1]),
            lambda v, g: np.concatenate([(g @ split(v)[0]).ravel(), 0.5 * np.diag(g) * split(v)[1]]),
        )
    raise ValueError(f"unknown structure {name}; one of {multitrait.STRUCTURES}")


@dataclass(frozen=True)
class Stacked:
    """What the scan needs of a fit over stacked rows: P y (traits, samples) and P (traits, samples, traits, samples)."""

    residual: np.ndarray
    projection: np.ndarray | thin.StackedProjection


@dataclass(frozen=True)
class CurveFit:
    """A null fit; columns are coefficient * environments + environment."""

    samples: tuple
    environments: tuple
    basis: Basis
    covariances: tuple[np.ndarray, ...]  # one for each kernel
    residual: np.ndarray
    log_likelihood: float
    settled: bool
    inner: multitrait.NullFit | Stacked


def _stacked(y: np.ndarray, x: np.ndarray, kernels: list[np.ndarray], size: int, envs: int, structure: str, rounds: int) -> tuple:
    n, d = y.shape
    seen = ~np.isnan(y).T
    trait, who = np.nonzero(seen)
    rows = len(trait)
    if rows**2 * 8 * (len(kernels) + 3) > mixed.MOST_BYTES:
        raise ValueError(f"{rows} rows of samples, environments and coefficients are too many for a dense fit")
    values, c = y.T[seen], x.shape[1]
    scale = float(np.nanstd(y)) or 1.0
    values = values / scale
    full = np.zeros((rows, d * c))
    for k in range(d):
        full[trait == k, k * c : (k + 1) * c] = x[who[trait == k]]
    near = [k[np.ix_(who, who)] for k in kernels] + [(who[:, None] == who[None]).astype(float)]
    member = (trait[:, None] == np.arange(d)[None]).astype(float)
    var = np.diag(np.nanvar(y, axis=0) / scale**2 + 1e-4)
    parts = [_structure(structure, size, envs, var / 2 / len(kernels)) for _ in kernels] + [_structure("diagonal" if structure == "diagonal" else "unstructured", size, envs, var / 2)]
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    split = lambda v: [v[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    memory: dict = {}

    def at(v: np.ndarray):
        if memory.get("v") is None or not np.array_equal(memory["v"], v):
            found = [p[1](q) for p, q in zip(parts, split(v), strict=True)]
            cov = sum(s[np.ix_(trait, trait)] * k for s, k in zip(found, near, strict=True))
            half = np.linalg.inv(np.linalg.cholesky(cov))
            inverse = half.T @ half
            ix = inverse @ full
            gram = full.T @ ix
            p = inverse - ix @ np.linalg.solve(gram, ix.T)
            py = p @ values
            objective = -np.log(np.diag(half)).sum() + 0.5 * np.linalg.slogdet(gram)[1] + 0.5 * values @ py
            memory.update(v=v.copy(), found=found, p=p, py=py, objective=float(objective))
        return memory

    def value(v: np.ndarray) -> float:
        try:
            return at(v)["objective"]
        except np.linalg.LinAlgError:
            return math.inf

    def gradient(v: np.ndarray) -> np.ndarray:
        now = at(v)
        m = now["p"] - np.outer(now["py"], now["py"])
        return np.concatenate([p[2](q, member.T @ (m * k) @ member) for p, q, k in zip(parts, split(v), near, strict=True)])

    best, objective, settled = reml.minimise(value, np.concatenate([p[0] for p in parts]), rounds, gradient=gradient)
    now = at(best)
    residual, projection = np.zeros(d * n), np.zeros((d * n, d * n))
    at_flat = np.flatnonzero(seen.ravel())
    residual[at_flat], projection[np.ix_(at_flat, at_flat)] = now["py"] / scale, now["p"] / scale**2
    covariances = [s * scale**2 for s in now["found"]]
    likelihood = -objective - 0.5 * (rows - d * c) * math.log(2 * math.pi) - (rows - d * c) * math.log(scale)
    return covariances, likelihood, settled, Stacked(residual.reshape(d, n), projection.reshape(d, n, d, n))


def _complete(y: np.ndarray, x: np.ndarray, factors: list[np.ndarray]) -> Callable:
    """A function of the covariances, the residual one last, that gives the objective of `_factored` and the derivatives by each, for samples seen in every column.

    Free of the design, with traits whitened by the residual and each factor along its own axes, a kernel's own block
    is diagonal: the first kernel is eliminated by divisions, and only the columns of the others meet in a matrix.
    """
    n, d = y.shape
    c = x.shape[1]
    free = lambda m: m - x @ np.linalg.lstsq(x, m, rcond=None)[0]
    y, turned = free(y), []
    for a in map(free, factors):
        values, vectors = np.linalg.eigh(a.T @ a)
        turned.append(a @ vectors[:, values > 1e-13 * values.max(initial=0.0)])
    widths = [a.shape[1] for a in turned]
    ends = np.cumsum([0, *widths])
    own = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    m = np.column_stack(turned)
    g, h, yy = m.T @ m, y.T @ m, y.T @ y
    spread = [np.diag(g[o, o]).copy() for o in own]
    design = d * np.linalg.slogdet(x.T @ x)[1]

    def at(covariances: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        chol = np.linalg.cholesky(covariances[-1])
        if np.diag(chol).min() < 1e-5 * np.diag(chol).max():
            raise np.linalg.LinAlgError("the residual covariance is singular in working precision")
        half = np.linalg.inv(chol)
        loads = []
        for cov in covariances[:-1]:
            values, vectors = np.linalg.eigh(half @ cov @ half.T)
            loads.append(vectors * np.sqrt(np.maximum(values, 1e-13 * max(values[-1], 1e-13))))
        between = lambda k, j: np.kron(loads[k].T @ loads[j], g[own[k], own[j]])
        first = 1 + (loads[0] ** 2).sum(axis=0)[:, None] * spread[0][None]
        rights = [(load.T @ half @ h[:, o]).ravel() for load, o in zip(loads, own, strict=True)]
        others = range(1, len(loads))
        across = np.column_stack([between(0, k) for k in others])
        rest = np.block([[between(k, j) for j in others] for k in others])
        rest[np.diag_indices(len(rest))] += 1
        # across' first^-1 across, trait by trait of the first kernel
        mixes, cross = [loads[0].T @ loads[k] for k in others], g[own[0], ends[1] :]
        places = np.concatenate([[0], np.cumsum([d * widths[k] for k in others])])
        for t in range(d):
            z = cross.T @ (cross / first[t][:, None])
            for i, k in enumerate(others):
                for j, l in enumerate(others):
                    piece = z[ends[k] - ends[1] : ends[k + 1] - ends[1], ends[l] - ends[1] : ends[l + 1] - ends[1]]
                    rest[places[i] : places[i + 1], places[j] : places[j + 1]] -= np.kron(np.outer(mixes[i][t], mixes[j][t]), piece)
        lower = np.linalg.cholesky(rest)
        inverse = np.linalg.inv(rest)
        divided = rights[0] / first.ravel()
        v_rest = inverse @ (np.concatenate(rights[1:]) - across.T @ divided)
        v = [(rights[0] - across @ v_rest) / first.ravel(), *np.split(v_rest, places[1:-1])]
        u = np.column_stack([load @ w.reshape(d, -1) for load, w in zip(loads, v, strict=True)])
        q, left = half @ h - u @ g, half @ yy @ half.T - half @ h @ u.T - u @ h.T @ half.T + u @ g @ u.T
        determinant = 2 * (n - c) * np.log(np.diag(chol)).sum() + np.log(first).sum() + 2 * np.log(np.diag(lower)).sum()
        objective = 0.5 * (determinant + design + np.trace(left) + sum(w @ w for w in v))
        # traces of the blocks of the inverse, by pairs of traits
        traces = [np.diag((1 / first).sum(axis=1))]
        wide = across.reshape(d, widths[0], -1) / first[:, :, None]
        carried = (wide.reshape(d * widths[0], -1) @ inverse).reshape(d, widths[0], -1)
        traces[0] = traces[0] + np.tensordot(carried, wide, ([1, 2], [1, 2]))
        for i, k in enumerate(others):
            block = inverse[places[i] : places[i + 1], places[i] : places[i + 1]].reshape(d, widths[k], d, widths[k])
            traces.append(np.einsum("acbc->ab", block))
        slopes, whole = [], (n - c) * np.eye(d)
        for load, o, width, trace in zip(loads, own, widths, traces, strict=True):
            back = load / (load**2).sum(axis=0)  # the inverse of its transpose
            within = back @ (width * np.eye(d) - trace) @ back.T
            whole = whole - load @ load.T @ within
            slopes.append(half.T @ (within - q[:, o] @ q[:, o].T) @ half)
        slopes.append(half.T @ ((whole + whole.T) / 2 - left) @ half)
        return float(objective), slopes

    return at


def _factored(y: np.ndarray, x: np.ndarray, kernels: list[thin.Thin], size: int, envs: int, structure: str, rounds: int) -> tuple:
    """What `_stacked` gives, by the factors of the kernels: samples seen in the same columns share their products, which are made once."""
    n, d = y.shape
    scale, c = float(np.nanstd(y)) or 1.0, x.shape[1]
    m = np.column_stack([*(k.factor for k in kernels), x])
    widths = [k.factor.shape[1] for k in kernels]
    r, cols = sum(widths), m.shape[1]
    ends_of = np.cumsum([0, *widths])
    seen = ~np.isnan(y)
    filled = np.where(seen, y, 0.0) / scale
    patterns, of = np.unique(seen, axis=0, return_inverse=True)
    of = of.ravel()
    counts = np.bincount(of)
    grams = [m[of == k].T @ m[of == k] for k in range(len(patterns))]
    against = [filled[of == k].T @ m[of == k] for k in range(len(patterns))]
    squares = [filled[of == k].T @ filled[of == k] for k in range(len(patterns))]
    var = np.diag(np.nanvar(y, axis=0) / scale**2 + 1e-4)
    parts = [_structure(structure, size, envs, var / 2 / len(kernels)) for _ in kernels] + [_structure("diagonal" if structure == "diagonal" else "unstructured", size, envs, var / 2)]
    ends = np.cumsum([0, *(len(p[0]) for p in parts)])
    split = lambda v: [v[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    effects, fixed = (np.arange(d)[:, None] * cols + at[None] for at in (np.arange(r), np.arange(r, cols)))
    effects, fixed = effects.ravel(), fixed.ravel()
    memory: dict = {}

    def at(v: np.ndarray):
        if memory.get("v") is None or not np.array_equal(memory["v"], v):
            found = [p[1](q) for p, q in zip(parts, split(v), strict=True)]
            weights, determinant = np.zeros((len(patterns), d, d)), 0.0
            for k, pattern in enumerate(patterns):
                if pattern.any():
                    own = np.ix_(pattern, pattern)
                    chol = np.linalg.cholesky(found[-1][own])
                    if np.diag(chol).min() < 1e-5 * np.diag(chol).max():
                        raise np.linalg.LinAlgError("the residual covariance is singular in working precision")
                    half = np.linalg.inv(chol)
                    weights[(k, *own)] = half.T @ half
                    determinant += counts[k] * 2 * np.log(np.diag(chol)).sum()
            whole = sum(np.kron(w, g) for w, g in zip(weights, grams, strict=True))
            right = sum(w @ h for w, h in zip(weights, against, strict=True)).ravel()
            gram_a, cross = whole[np.ix_(effects, effects)], whole[np.ix_(effects, fixed)]
            load = np.zeros((d, r, d, r))
            for k, cov in enumerate(found[:-1]):
                values, vectors = np.linalg.eigh(cov)
                for col in range(ends_of[k], ends_of[k + 1]):
                    load[:, col, :, col] = vectors * np.sqrt(np.maximum(values, 0))
            load = load.reshape(d * r, d * r)
            chol = np.linalg.cholesky(np.eye(d * r) + load.T @ gram_a @ load)
            half = np.linalg.solve(chol, load.T)
            middle = half.T @ half
            mc = middle @ cross
            gram = whole[np.ix_(fixed, fixed)] - cross.T @ mc
            inverse = np.linalg.inv(gram)
            beta = inverse @ (right[fixed] - mc.T @ right[effects])
            u = middle @ (right[effects] - cross @ beta)
            inner = np.zeros((d * cols, d * cols))
            inner[np.ix_(effects, effects)] = middle + mc @ inverse @ mc.T
            inner[np.ix_(effects, fixed)] = -mc @ inverse
            inner[np.ix_(fixed, effects)] = inner[np.ix_(effects, fixed)].T
            inner[np.ix_(fixed, fixed)] = inverse
            theta = np.zeros(d * cols)
            theta[effects], theta[fixed] = u, beta
            # as squares, not as a difference of large sums
            apart = [s - h @ t.T - t @ h.T + t @ g @ t.T for t in [theta.reshape(d, cols)] for g, h, s in zip(grams, against, squares, strict=True)]
            v0 = np.linalg.solve(chol.T, half @ (right[effects] - cross @ beta))
            total = sum((w * left).sum() for w, left in zip(weights, apart, strict=True)) + v0 @ v0
            objective = 0.5 * (determinant + 2 * np.log(np.diag(chol)).sum() + np.linalg.slogdet(gram)[1] + total)
            left = cross - gram_a @ mc
            memory.update(v=v.copy(), found=found, weights=weights, middle=middle, cross=cross, inverse=inverse, inner=inner, theta=theta.reshape(d, cols), apart=apart, objective=float(objective))
            memory.update(within=lambda: gram_a - gram_a @ middle @ gram_a - left @ inverse @ left.T, q=(right[effects] - whole[np.ix_(effects, effects)] @ u - cross @ beta).reshape(d, r))
        return memory

    def value(v: np.ndarray) -> float:
        try:
            return at(v)["objective"]
        except np.linalg.LinAlgError:
            return math.inf

    def gradient(v: np.ndarray) -> np.ndarray:
        now = at(v)
        within, q = now["within"]().reshape(d, r, d, r), now["q"]
        slopes = []
        for k in range(len(kernels)):
            own = slice(ends_of[k], ends_of[k + 1])
            slopes.append(np.einsum("acbc->ab", within[:, own, :, own]) - q[:, own] @ q[:, own].T)
        inner, rest = now["inner"].reshape(d, cols, d, cols), np.zeros((d, d))
        for w, g, left, count in zip(now["weights"], grams, now["apart"], counts, strict=True):
            rest += count * w - w @ (np.tensordot(inner, g, ([1, 3], [0, 1])) + left) @ w
        return np.concatenate([p[2](q, g) for p, q, g in zip(parts, split(v), [*slopes, rest], strict=True)])

    whole_rows = bool(seen.all()) and len(kernels) > 1
    if whole_rows:
        quick, kept = _complete(filled, x, [k.factor for k in kernels]), {}

        def both(v: np.ndarray) -> tuple[float, list[np.ndarray]]:
            if not np.array_equal(kept.get("v"), v):
                kept.update(v=v.copy(), found=quick([p[1](q) for p, q in zip(parts, split(v), strict=True)]))
            return kept["found"]

        def value(v: np.ndarray) -> float:
            try:
                return both(v)[0]
            except np.linalg.LinAlgError:
                return math.inf

        def gradient(v: np.ndarray) -> np.ndarray:
            return np.concatenate([p[2](q, g) for p, q, g in zip(parts, split(v), both(v)[1], strict=True)])

    best, objective, settled = reml.minimise(value, np.concatenate([p[0] for p in parts]), rounds, gradient=gradient, curved=whole_rows)
    now = at(best)
    weights = np.ascontiguousarray(np.moveaxis(now["weights"][of], 0, 2))
    residual = np.einsum("abi,ib->ai", weights, filled - m @ now["theta"].T) / scale
    projection = thin.StackedProjection(weights / scale**2, m[:, :r], x, now["middle"] * scale**2, now["cross"] / scale**2, now["inverse"] * scale**2)
    rows = int(seen.sum())
    likelihood = -objective - 0.5 * (rows - d * c) * math.log(2 * math.pi) - (rows - d * c) * math.log(scale)
    return [s * scale**2 for s in now["found"]], likelihood, settled, Stacked(residual, projection)


def fit(y: np.ndarray, x: np.ndarray, kernels: list[np.ndarray], samples: list, environments: list, basis: Basis, structure: str = "separable", rounds: int = 300) -> CurveFit:
    """REML of the coefficients' covariances; the residual one is free, but diagonal where the structure is. ``y`` is that of `traits`; a sample seen nowhere only adds nothing."""
    size, envs = basis.size, len(environments)
    if y.shape[1] != size * envs or size < 2 or envs < 2:
        raise ValueError("curves in environments need two coefficients and two environments, or more")
    if structure == "unstructured" and size * envs > 12:
        raise ValueError("an unstructured covariance has at most 12 columns; use separable or fa<k>")
    if len(kernels) == 1 and not np.isnan(y).any():
        scale = float(y.std()) or 1.0
        inner = multitrait.fit(y / scale, x, kernels[0], samples, structure, (size, envs), rounds)
        values, vectors, _ = thin.axes(kernels[0], y, x)
        inner = multitrait.null_fit(y, x, values, vectors, samples, inner.vg * scale**2, inner.ve * scale**2)
        return CurveFit(tuple(samples), tuple(environments), basis, (inner.vg,), inner.ve, inner.log_likelihood, True, inner)
    if all(isinstance(k, thin.Thin) for k in kernels):
        found, likelihood, settled, inner = _factored(y, x, kernels, size, envs, structure, rounds)
    else:
        found, likelihood, settled, inner = _stacked(y, x, [k.dense() if isinstance(k, thin.Thin) else k for k in kernels], size, envs, structure, rounds)
    if not settled:
        warnings.warn(f"the covariances of the curves had not settled after {rounds} rounds", stacklevel=2)
    return CurveFit(tuple(samples), tuple(environments), basis, tuple(found[:-1]), found[-1], likelihood, settled, inner)


def contrasts(size: int, envs: int) -> dict[str, np.ndarray]:
    """The tested combinations of (coefficient, environment) effects, by name.

    All; the curve, its level and its change in each environment; one coefficient, the level or the whole
    curve alike in all environments; the mean curve.
    """
    coefficient, env = np.eye(size), np.eye(envs)
    apart = env[:-1] - env[1:]
    out = {"all": np.eye(size * envs)}
    for e in range(envs):
        out |= {f"e{e}": np.kron(coefficient, env[[e]]), f"level_e{e}": np.kron(coefficient[[0]], env[[e]]), f"change_e{e}": np.kron(coefficient[1:], env[[e]])}
    out |= {f"gxe_c{k}": np.kron(coefficient[[k]], apart) for k in range(size)}
    return out | {"gxe": np.kron(coefficient, apart), "gxe_level": np.kron(coefficient[[0]], apart), "mean": np.kron(coefficient, np.full((1, envs), 1 / envs))}


def _effects(g: np.ndarray, fit: CurveFit) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(fit.inner, multitrait.NullFit):
        return multitrait._effects(g, fit.inner)
    d, m = len(fit.inner.residual), g.shape[1]
    u, info = (fit.inner.residual @ g).T, np.empty((m, d, d))
    if isinstance(fit.inner.projection, thin.StackedProjection):
        info = np.moveaxis(fit.inner.projection.forms(g), 2, 0)
    else:
        for a in range(d):
            for b in range(a, d):
                info[:, a, b] = info[:, b, a] = (g * (fit.inner.projection[a, :, b] @ g)).sum(axis=0)
    spread = np.linalg.eigvalsh(info)
    ok = spread[:, 0] > 1e-9 * np.maximum(spread[:, -1], 1e-300)
    inverse = np.full_like(info, np.nan)
    inverse[ok] = np.linalg.inv(info[ok])
    return np.einsum("mjk,mk->mj", inverse, u), inverse


def score(g: np.ndarray, state: tuple[CurveFit, tuple[float, ...]]) -> dict[str, np.ndarray]:
    """Wald tests of columns, and with times the effect in each environment at each of them."""
    fit, times = state
    size, envs = fit.basis.size, len(fit.environments)
    beta, cov = _effects(g, fit)
    ok = ~np.isnan(beta[:, 0])
    out = {}
    for name, c in contrasts(size, envs).items():
        stat = np.full(len(beta), np.nan)
        d = beta[ok] @ c.T
        stat[ok] = np.einsum("mj,mj->m", d, np.linalg.solve(c @ cov[ok] @ c.T, d[:, :, None])[:, :, 0])
        p = np.where(np.isnan(stat), np.nan, np.clip(specfun.chi2_sf(np.nan_to_num(stat), float(len(c))), specfun.FLOOR, 1))
        out |= {f"stat_{name}": stat, f"p_{name}": p}
    se = np.sqrt(np.diagonal(cov, axis1=1, axis2=2))
    for k in range(size):
        for e in range(envs):
            out |= {f"beta_c{k}_e{e}": beta[:, k * envs + e], f"se_c{k}_e{e}": se[:, k * envs + e]}
    if times:
        for j, row in enumerate(fit.basis.values(np.array(times))):
            for e in range(envs):
                c = np.kron(row, np.eye(envs)[e])
                effect, spread = beta @ c, np.sqrt(np.einsum("j,mjk,k->m", c, cov, c))
                tail = np.clip(specfun.chi2_sf(np.nan_to_num((effect / spread) ** 2), 1.0), specfun.FLOOR, 1)
                out |= {f"effect_t{j}_e{e}": effect, f"p_t{j}_e{e}": np.where(np.isnan(effect), np.nan, tail)}
    return out


def scan(cells: DataFrame, fit: CurveFit, times: tuple[float, ...] = ()) -> DataFrame:
    """(v_idx, stat_ and p_ of each of `contrasts`, beta_c0_e0 .., se_c0_e0 .., and effect_t0_e0, p_t0_e0 .. at ``times``).

    A variant without variance in the rows seen has NaN.
    """
    if isinstance(fit.inner, Stacked) and fit.inner.projection.nbytes > mixed.MOST_BYTES:
        raise ValueError(f"the projection of {len(fit.samples)} samples is too large to broadcast")
    shape = score(np.zeros((len(fit.samples), 1)), (fit, tuple(times)))
    return map_variants(cells, list(fit.samples), score, (fit, tuple(times)), ", ".join(f"{name} double" for name in shape))


# What a fit says about its curves; kernels add up.


def surfaces(fit: CurveFit, times: np.ndarray) -> dict[str, np.ndarray]:
    """Genetic and residual variance and heritability (times x environments), and genetic correlation of environments at each time."""
    phi, size, envs = fit.basis.values(times), fit.basis.size, len(fit.environments)
    at = lambda v: np.einsum("ta,aebf,tb->tef", phi, v.reshape(size, envs, size, envs), phi)
    genetic, residual = at(sum(fit.covariances)), np.diagonal(at(fit.residual), axis1=1, axis2=2)
    own = np.diagonal(genetic, axis1=1, axis2=2)
    sd = np.sqrt(np.maximum(own, 1e-300))
    return {"genetic": own, "residual": residual, "heritability": own / np.maximum(own + residual, 1e-300), "correlation": genetic / sd[:, :, None] / sd[:, None, :]}


def eigenfunctions(fit: CurveFit, environment: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of one environment's genetic variance of its axes, and each axis as a curve over time."""
    envs = len(fit.environments)
    own = sum(fit.covariances)[environment::envs, environment::envs]
    lam, q = np.linalg.eigh(own)
    return np.maximum(lam[::-1], 0) / max(lam.sum(), 1e-300), fit.basis.values(times) @ q[:, ::-1]


def independent(y: np.ndarray, x: np.ndarray, samples: list, environments: list, basis: Basis) -> CurveFit:
    """The model without genetic covariance and with uncorrelated columns: a least-squares scan of each, which has a closed form."""
    left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    ve = np.diag((left**2).sum(axis=0) / (len(y) - x.shape[1]))
    bare = ve - 1e-10 * np.trace(ve) * np.eye(len(ve))  # `multitrait.precisions` adds that much
    values, vectors, _ = thin.axes(thin.Thin(np.zeros((len(y), 1))), y, x)  # only axes that hold traits and design
    inner = multitrait.null_fit(y, x, values, vectors, samples, np.zeros_like(ve), bare)
    return CurveFit(tuple(samples), tuple(environments), basis, (inner.vg,), ve, inner.log_likelihood, True, inner)
