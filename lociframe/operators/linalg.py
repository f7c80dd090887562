"""Dense algebra and bases that models need on the driver: matrices in samples, traits or knots."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from .longitudinal import bspline, difference_penalty


def symmetric(k: np.ndarray) -> np.ndarray:
    return (k + np.swapaxes(k, -1, -2)) / 2


def safe_cholesky(k: np.ndarray, jitter: float = 1e-8, tries: int = 8) -> tuple[np.ndarray, float]:
    """Cholesky factor (of one matrix or a stack), with as little added to the diagonal, relative to its mean, as is needed; and what was added."""
    k = symmetric(np.asarray(k, float))
    n = k.shape[-1]
    scale = np.maximum(np.abs(np.diagonal(k, axis1=-2, axis2=-1)).mean(), 1e-300)
    added = 0.0
    for t in range(tries + 1):
        try:
            return np.linalg.cholesky(k + added * np.eye(n)), added
        except np.linalg.LinAlgError:
            added = jitter * 10**t * scale
    raise np.linalg.LinAlgError("matrix is far from positive definite")


def cholesky_solve(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve L L' x = b for one factor or a stack of them."""
    return np.linalg.solve(np.swapaxes(factor, -1, -2), np.linalg.solve(factor, b))


def safe_logdet(k: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(safe_cholesky(k)[0])).sum())


def woodbury_inverse(a_inverse: np.ndarray, u: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inverse of A + U C V from that of A."""
    left, right = a_inverse @ u, v @ a_inverse
    return a_inverse - left @ np.linalg.solve(np.linalg.inv(c) + v @ left, right)


def woodbury_logdet(a_logdet: float, a_inverse: np.ndarray, u: np.ndarray, c: np.ndarray, v: np.ndarray) -> float:
    """log |A + U C V| from log |A| and the inverse of A."""
    return a_logdet + np.linalg.slogdet(c)[1] + np.linalg.slogdet(np.linalg.inv(c) + v @ a_inverse @ u)[1]


def rotate(m: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return vectors.T @ m


def weights(values: np.ndarray, sigma2_g: float, sigma2_e: float) -> np.ndarray:
    """Inverse variances of samples in the eigenbasis."""
    return 1 / np.maximum(values * sigma2_g + sigma2_e, 1e-300)


def randomised_eigen(k: np.ndarray, n: int, extra: int = 10, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and vectors of a symmetric matrix from products with a few random vectors."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(k @ rng.standard_normal((len(k), min(len(k), n + extra))))[0]
    for _ in range(power):
        q = np.linalg.qr(k @ q)[0]
    values, vectors = np.linalg.eigh(symmetric(q.T @ k @ q))
    return values[::-1][:n], (q @ vectors)[:, ::-1][:, :n]


def block_gradient_eigen(matvec, size: int, n: int, rounds: int = 200, tol: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenpairs from products alone: the best combinations of the current block, its residuals and the last directions."""
    rng = np.random.default_rng(seed)
    x = np.linalg.qr(rng.standard_normal((size, n)))[0]
    last = np.zeros((size, 0))
    values = np.zeros(n)
    for _ in range(rounds):
        ax = matvec(x)
        values = (x * ax).sum(axis=0)
        r = ax - x * values
        if np.linalg.norm(r, axis=0).max() <= tol * max(np.abs(values).max(), 1e-300):
            break
        basis = np.linalg.qr(np.column_stack([x, r, last]))[0]
        small = symmetric(basis.T @ matvec(basis))
        w, v = np.linalg.eigh(small)
        best = v[:, ::-1][:, :n]
        new = basis @ best
        last = new - x @ (x.T @ new)
        x = new
    order = np.argsort(values)[::-1]
    return values[order], x[:, order]


def nystrom(cells: DataFrame, samples: list[int], landmarks: int, ploidy: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a relationship matrix of rank ``landmarks`` at most, from the columns of sampled landmarks only.

    Spark makes the products of all samples with the landmarks, n x landmarks numbers.
    """
    from .kinship import _norm, encoded

    order = np.array(sorted(samples))
    chosen = np.sort(np.random.default_rng(seed).choice(len(order), min(landmarks, len(order)), replace=False))
    rows = encoded(cells, "vanraden", ploidy).persist()
    marked = rows.where(F.col("s_idx").isin([int(s) for s in order[chosen]])).select("v_idx", F.col("s_idx").alias("j"), F.col("x").alias("y"))
    sums = rows.select("v_idx", F.col("s_idx").alias("i"), "x").join(marked, "v_idx").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("k"))
    c = np.zeros((len(order), len(chosen)))
    got = sums.toPandas()
    c[np.searchsorted(order, got["i"]), np.searchsorted(order[chosen], got["j"])] = got["k"]
    c /= max(_norm(rows).first()["norm"] or 0.0, 1e-10)
    rows.unpersist()
    values, vectors = np.linalg.eigh(symmetric(c[chosen]))
    live = values > 1e-10 * max(values.max(), 1e-300)
    half = c @ (vectors[:, live] / np.sqrt(values[live]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return s**2, u


# Separable covariances: Vg = A (x) B and Ve = C (x) D diagonalised together.


@dataclass(frozen=True)
class Joint:
    """Bases that turn both covariances to diagonals, and the eigenvalues of one against the other."""

    first: np.ndarray
    second: np.ndarray
    values: np.ndarray


def joint_diagonal(vg: np.ndarray, ve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T with T' Ve T = I and T' Vg T diagonal, and that diagonal."""
    half = np.linalg.inv(safe_cholesky(ve)[0]).T
    values, q = np.linalg.eigh(symmetric(half.T @ vg @ half))
    return half @ q, np.maximum(values, 0)


def kronecker_diagonal(vg_first: np.ndarray, vg_second: np.ndarray, ve_first: np.ndarray, ve_second: np.ndarray) -> Joint:
    first, a = joint_diagonal(vg_first, ve_first)
    second, b = joint_diagonal(vg_second, ve_second)
    return Joint(first, second, np.kron(a, b))


def nearest_kronecker(v: np.ndarray, d: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """The separable matrix A (x) B nearest to v in squares, A being d x d."""
    turned = v.reshape(d, e, d, e).transpose(0, 2, 1, 3).reshape(d * d, e * e)
    u, s, w = np.linalg.svd(turned, full_matrices=False)
    a, b = u[:, 0].reshape(d, d) * math.sqrt(s[0]), w[0].reshape(e, e) * math.sqrt(s[0])
    sign = math.copysign(1.0, np.trace(a))
    return symmetric(a * sign), symmetric(b * sign)


def kronecker_rotate(m: np.ndarray, joint: Joint) -> np.ndarray:
    """Rows of m (n x d e) times (first (x) second), without forming the product."""
    d, e = len(joint.first), len(joint.second)
    return np.einsum("nde,da,eb->nab", m.reshape(-1, d, e), joint.first, joint.second).reshape(len(m), d * e)


def kronecker_back(m: np.ndarray, joint: Joint) -> np.ndarray:
    """Undo `kronecker_rotate`."""
    return kronecker_rotate(m, Joint(np.linalg.inv(joint.first), np.linalg.inv(joint.second), joint.values))


def kronecker_precision(joint: Joint, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse variances (n x d e) in the joint basis, and the log determinant of each sample's covariance."""
    scale = 1 / (values[:, None] * joint.values[None] + 1)
    d, e = len(joint.first), len(joint.second)
    base = -2 * (e * np.linalg.slogdet(joint.first)[1] + d * np.linalg.slogdet(joint.second)[1])
    return scale, -np.log(scale).sum(axis=1) + base


def factor_precision(loadings: np.ndarray, specific: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and log determinant of d_i L L' + diag(d_i psi + 1) for each eigenvalue, through the small side of the factors."""
    own = 1 / (values[:, None] * specific[None] + 1)
    k = loadings.shape[1]
    scaled = own[:, :, None] * loadings[None]
    inner = np.eye(k)[None] + values[:, None, None] * np.einsum("ja,ijb->iab", loadings, scaled)
    solved = np.linalg.solve(inner, np.swapaxes(scaled, 1, 2))
    inverse = own[:, :, None] * np.eye(len(loadings)) - values[:, None, None] * scaled @ solved
    return inverse, np.linalg.slogdet(inner)[1] - np.log(own).sum(axis=1)


# Bases of time and place.


def standardised_time(t: np.ndarray, low: float, high: float) -> np.ndarray:
    return 2 * (np.asarray(t, float) - low) / (high - low) - 1 if high > low else np.zeros(len(t))


def legendre(t: np.ndarray, order: int) -> np.ndarray:
    """Normalised Legendre polynomials of orders 0 .. order at standardised times."""
    plain = [np.ones(len(t)), np.asarray(t, float)]
    for k in range(1, order):
        plain.append(((2 * k + 1) * t * plain[k] - k * plain[k - 1]) / (k + 1))
    return np.stack([math.sqrt((2 * k + 1) / 2) * p for k, p in enumerate(plain[: order + 1])], axis=1)


def knots(t: np.ndarray, interior: int, kind: str = "quantile") -> np.ndarray:
    """Boundary and interior knots, evenly spaced or at quantiles of the times."""
    inner = np.linspace(0, 1, interior + 2)
    return np.quantile(t, inner) if kind == "quantile" else t.min() + inner * (t.max() - t.min())


def surface(rows: np.ndarray, columns: np.ndarray, row_knots: int, column_knots: int, degree: int = 3, order: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensor product of spline bases over a field's rows and columns, and the penalties of each direction."""
    a, b = bspline(rows, knots(rows, row_knots, "even"), degree), bspline(columns, knots(columns, column_knots, "even"), degree)
    basis = (a[:, :, None] * b[:, None, :]).reshape(len(rows), -1)
    return basis, np.kron(difference_penalty(a.shape[1], order), np.eye(b.shape[1])), np.kron(np.eye(a.shape[1]), difference_penalty(b.shape[1], order))


def basis_at(t: np.ndarray, kind: str, **stored) -> np.ndarray:
    """A stored basis at new times: legendre (low, high, order) or bspline (knots, degree)."""
    if kind == "legendre":
        return legendre(standardised_time(t, stored["low"], stored["high"]), stored["order"])
    if kind == "bspline":
        return bspline(np.asarray(t, float), stored["knots"], stored.get("degree", 3))
    raise ValueError(f"unknown basis {kind}")


# Truncated normal variables.


def truncated_moments(mean, sd, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a normal variable within limits."""
    mean, sd, low, high = (np.asarray(v, float) for v in np.broadcast_arrays(mean, sd, low, high))
    a, b = (low - mean) / sd, (high - mean) / sd
    turned = a > 0  # the far tail is exact on the other side
    a, b = np.where(turned, -b, a), np.where(turned, -a, b)
    mass = np.maximum(specfun.norm_cdf(b) - specfun.norm_cdf(a), 1e-300)
    pa, pb = specfun.norm_pdf(a), specfun.norm_pdf(b)
    shift = (pa - pb) / mass
    edge = lambda x, p: np.where(np.isfinite(x), np.where(np.isfinite(x), x, 0.0) * p, 0.0)
    var = 1 + (edge(a, pa) - edge(b, pb)) / mass - shift**2
    return mean + sd * np.where(turned, -shift, shift), sd**2 * np.clip(var, 0, None)


def truncated_normal(mean: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray, draws: int = 8192, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and probability of a normal vector within limits, by drawing one element after the other within its limits and weighting (Genz)."""
    chol = safe_cholesky(cov)[0]
    d = len(mean)
    # additive recurrence with the roots of primes: low discrepancy, reproducible
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))][:d]
    u = (np.random.default_rng(seed).random(d)[None] + np.arange(1, draws + 1)[:, None] * np.sqrt(primes)[None]) % 1
    z, weight = np.zeros((draws, d)), np.ones(draws)
    for k in range(d):
        at = mean[k] + z[:, :k] @ chol[k, :k]
        a, b = specfun.norm_cdf((low[k] - at) / chol[k, k]), specfun.norm_cdf((high[k] - at) / chol[k, k])
        weight *= np.maximum(b - a, 0)
        z[:, k] = specfun.norm_ppf(np.clip(a + u[:, k] * (b - a), 1e-15, 1 - 1e-15))
    x = mean + z @ chol.T
    total = max(weight.sum(), 1e-300)
    m = weight @ x / total
    return m, (weight[:, None] * (x - m)).T @ (x - m) / total, float(weight.mean())
