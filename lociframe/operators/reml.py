"""Fitting of variance components on the driver, and solvers that need products with the covariance only.

Single-trait functions work in the eigenbasis of the relationship matrix: y and x are rotated, and
``values`` are the eigenvalues. The covariance is sigma2_g K + sigma2_e I and ratio its quotient.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Components:
    """Fitted variances, the REML log likelihood, and whether the steps settled."""

    sigma2_g: float
    sigma2_e: float
    log_likelihood: float
    rounds: int
    converged: bool

    @property
    def ratio(self) -> float:
        return self.sigma2_g / self.sigma2_e


def _parts(ratio: float, y: np.ndarray, x: np.ndarray, values: np.ndarray):
    w = 1 / (ratio * values + 1)
    gram = x.T @ (w[:, None] * x)
    beta = np.linalg.solve(gram, x.T @ (w * y))
    return w, gram, w * (y - x @ beta)


def log_likelihood(ratio: float, y: np.ndarray, x: np.ndarray, values: np.ndarray) -> float:
    """REML log likelihood at a variance ratio, with the residual variance profiled out."""
    w, gram, py = _parts(ratio, y, x, values)
    df = len(y) - x.shape[1]
    s2 = max(float(y @ py) / df, 1e-300)
    return -0.5 * (df * math.log(2 * math.pi * s2) - np.log(w).sum() + np.linalg.slogdet(gram)[1] + df)


def derivatives(ratio: float, y: np.ndarray, x: np.ndarray, values: np.ndarray) -> tuple[float, float]:
    """First and second derivative of `log_likelihood` by the ratio.

    With P the projected inverse and D the eigenvalues, d(y'Py) = -y'PDPy and d(log determinants) = tr PD.
    """
    w, gram, py = _parts(ratio, y, x, values)
    df = len(y) - x.shape[1]
    inverse = np.linalg.inv(gram)
    wx = w[:, None] * x

    def project(v: np.ndarray) -> np.ndarray:
        return w * v - wx @ (inverse @ (wx.T @ v))

    d = values
    ypy, q1 = float(y @ py), float(py @ (d * py))
    q2 = float((d * py) @ project(d * py))
    xdx, xddx = wx.T @ (d[:, None] * wx), wx.T @ ((d * d * w)[:, None] * wx)
    trace = float((w * d).sum() - np.trace(inverse @ xdx))
    square = float((w * w * d * d).sum() - 2 * np.trace(inverse @ xddx) + np.trace(inverse @ xdx @ inverse @ xdx))
    first = 0.5 * (df * q1 / ypy - trace)
    second = 0.5 * (df * (q1 * q1 / ypy**2 - 2 * q2 / ypy) + square)
    return first, second


def _components(ratio: float, y: np.ndarray, x: np.ndarray, values: np.ndarray, rounds: int, settled: bool) -> Components:
    _, _, py = _parts(ratio, y, x, values)
    s2 = float(y @ py) / (len(y) - x.shape[1])
    return Components(ratio * s2, s2, log_likelihood(ratio, y, x, values), rounds, settled)


def newton(y: np.ndarray, x: np.ndarray, values: np.ndarray, start: float = 1.0, rounds: int = 50, tol: float = 1e-8, low: float = 1e-5, high: float = 1e5, expected: bool = False) -> Components:
    """Newton steps on the logarithm of the ratio (``expected``: with the squared gradient's scale, as Fisher scoring), halved until they climb."""
    t, top = math.log(start), log_likelihood(start, y, x, values)
    for n in range(rounds):
        ratio = math.exp(t)
        first, second = derivatives(ratio, y, x, values)
        slope, bend = first * ratio, second * ratio**2 + first * ratio
        if expected:
            w, gram, _ = _parts(ratio, y, x, values)
            share = ratio * values * w
            bend = -0.5 * max(float((share**2).sum() - share.sum() ** 2 / (len(y) - x.shape[1])), 1e-12)
        step = -slope / bend if bend < 0 else math.copysign(1.0, slope)
        step = max(-2.0, min(2.0, step))
        for _ in range(30):
            new = min(max(t + step, math.log(low)), math.log(high))
            value = log_likelihood(math.exp(new), y, x, values)
            if value >= top - 1e-12:
                break
            step /= 2
        moved, t, top = abs(new - t), new, max(top, value)
        if moved < tol:
            return _components(math.exp(t), y, x, values, n + 1, True)
    return _components(math.exp(t), y, x, values, rounds, False)


def fisher_scoring(y: np.ndarray, x: np.ndarray, values: np.ndarray, **options) -> Components:
    return newton(y, x, values, expected=True, **options)


def expectation_maximisation(y: np.ndarray, x: np.ndarray, values: np.ndarray, sigma2_g: float | None = None, sigma2_e: float | None = None, rounds: int = 500, tol: float = 1e-8, expanded: bool = True) -> Components:
    """REML by expectation maximisation; ``expanded`` rescales the genetic effect each round (parameter expansion), which takes far fewer."""
    n, c = x.shape
    start = float(np.var(y)) / 2
    a, e = sigma2_g or start, sigma2_e or start
    for k in range(rounds):
        v = 1 / (a * values + e)
        gram = np.linalg.inv(x.T @ (v[:, None] * x))
        vx = v[:, None] * x
        py = v * (y - x @ (gram @ (vx.T @ y)))
        p_diagonal = v - np.einsum("ij,jk,ik->i", vx, gram, vx)
        u = a * values * py  # predicted genetic part in the eigenbasis
        live = values > 1e-12
        spread = a * np.where(live, 1.0, 0.0) - a * a * values * p_diagonal * live
        new_a = float((u[live] ** 2 / values[live]).sum() + spread[live].sum()) / max(1, live.sum())
        residual = y - u
        new_e = (e * e * float(py @ py) + float((e - e * e * p_diagonal).sum())) / n
        if expanded:
            # the best multiple of u as a covariate of y given the other parts
            uu, uy = float((v * u * u).sum() - (vx.T @ u) @ gram @ (vx.T @ u)), float(u @ py)
            scale = min(max(uy / uu, 0.5), 2.0) if uu > 1e-300 else 1.0
            candidate = new_a * scale**2
            if log_likelihood(candidate / new_e, y, x, values) >= log_likelihood(new_a / new_e, y, x, values):
                new_a = candidate
        del residual
        moved = abs(new_a - a) + abs(new_e - e)
        a, e = max(new_a, 1e-10), max(new_e, 1e-10)
        if moved < tol * (a + e):
            break
    return Components(a, e, log_likelihood(a / e, y, x, values), k + 1, k + 1 < rounds)


def emma(y: np.ndarray, x: np.ndarray, values: np.ndarray, points: int = 100, low: float = -10.0, high: float = 10.0) -> Components:
    """A grid on the logarithm of delta = sigma2_e / sigma2_g, then golden-section search around the best point."""
    from .mixed import best_ratio

    return _components(best_ratio(lambda r: log_likelihood(r, y, x, values), low, high, points), y, x, values, points, True)


def fit(y: np.ndarray, x: np.ndarray, values: np.ndarray) -> Components:
    """A few rounds of expectation maximisation, Newton steps from there, and the grid search if these don't settle."""
    warm = expectation_maximisation(y, x, values, rounds=5)
    found = newton(y, x, values, start=min(max(warm.ratio, 1e-4), 1e4))
    if found.converged and math.isfinite(found.log_likelihood):
        return found
    other = emma(y, x, values)
    return other if other.log_likelihood >= found.log_likelihood or not math.isfinite(found.log_likelihood) else found


def accelerated(step: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 100, tol: float = 1e-8, low: float = -100.0, high: float = -1.0) -> tuple[np.ndarray, int]:
    """Fixed point of ``step`` by squared extrapolation: two steps give the length of a third. Returns the point and the rounds."""
    x = np.asarray(start, float)
    for n in range(rounds):
        one = step(x)
        r = one - x
        if np.abs(r).max() < tol:
            return one, n + 1
        two = step(one)
        v = (two - one) - r
        size = np.linalg.norm(v)
        alpha = max(low, min(high, -np.linalg.norm(r) / size)) if size > 1e-300 else -1.0
        x = step(x - 2 * alpha * r + alpha * alpha * v)
    return x, rounds


def minimise(value: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 200, tol: float = 1e-7, gradient: Callable[[np.ndarray], np.ndarray] | None = None, curved: bool = False) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton minimum (BFGS with halved steps); central differences where no gradient is given. Where it is ``curved``, the first steps go by the curvature at the start, from differences of slopes."""

    def slope(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for k in range(len(x)):
            h = 1e-5 * max(1.0, abs(x[k]))
            a, b = x.copy(), x.copy()
            a[k], b[k] = a[k] + h, b[k] - h
            out[k] = (value(a) - value(b)) / (2 * h)
        return out

    slope = gradient or slope
    x = np.asarray(start, float)
    f, g, inverse = value(x), slope(x), np.eye(len(x))
    if curved:
        steps = 1e-5 * np.maximum(1.0, np.abs(x))
        hessian = np.array([slope(x + h) - slope(x - h) for h in np.diag(steps)]) / (2 * steps[:, None])
        values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
        inverse = (vectors / np.maximum(np.abs(values), 1e-6 * np.abs(values).max())) @ vectors.T
    for _ in range(rounds):
        if np.abs(g).max() < tol * max(1.0, abs(f)):
            return x, f, True
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(len(x)), -g
        d *= min(1.0, 5.0 / max(np.abs(d).max(), 1e-300))
        t = 1.0
        while t > 1e-12:
            new = value(x + t * d)
            if math.isfinite(new) and new <= f + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            return x, f, True
        s = t * d
        g2 = slope(x + s)
        y = g2 - g
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        if abs(f - new) < tol * 1e-3 * max(1.0, abs(f)):
            return x + s, new, True
        x, f, g = x + s, new, g2
    return x, f, False


def average_information(y: np.ndarray, x: np.ndarray, kernels: list[np.ndarray], rounds: int = 100, tol: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray]:
    """Variances of several kernels and the residual by average-information REML with steps of expectation maximisation where one would leave the cone.

    Returns (variances, log likelihood, V^-1). The kernels are dense, so samples are those a driver matrix holds.
    """
    n, c = x.shape
    parts = [*kernels, np.eye(n)]
    s = np.full(len(parts), float(np.var(y)) / len(parts))

    def at(s: np.ndarray):
        v = sum(a * k for a, k in zip(s, parts, strict=True))
        chol = np.linalg.cholesky(v + 1e-10 * np.trace(v) / n * np.eye(n))
        half = np.linalg.inv(chol)
        inverse = half.T @ half
        vx = inverse @ x
        gram = x.T @ vx
        p = inverse - vx @ np.linalg.solve(gram, vx.T)
        py = p @ y
        ll = -0.5 * (2 * np.log(np.diag(chol)).sum() + np.linalg.slogdet(gram)[1] + y @ py + (n - c) * math.log(2 * math.pi))
        return ll, inverse, p, py

    ll, inverse, p, py = at(s)
    for _ in range(rounds):
        kpy = np.stack([k @ py for k in parts])
        score = np.array([-0.5 * ((p * k).sum() - py @ row) for k, row in zip(parts, kpy, strict=True)])
        information = 0.5 * kpy @ p @ kpy.T
        step = np.linalg.lstsq(information, score, rcond=None)[0]
        em = s + 2 * s * s / n * score
        t = 1.0
        while t > 1e-4:
            new = s + t * step
            new = np.where(new > 0, new, np.maximum(em, 1e-8 * s.sum()))
            try:
                found = at(new)
            except np.linalg.LinAlgError:
                found = None
            if found and found[0] >= ll - 1e-10:
                break
            t /= 2
        else:
            new = np.maximum(em, 1e-10)
            found = at(new)
        moved, gain = np.abs(new - s).max() / s.sum(), found[0] - ll
        s, (ll, inverse, p, py) = new, found
        if moved < tol or abs(gain) < 1e-9:
            break
    return s, float(ll), inverse


def conjugate_gradient(matvec: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray | None = None, start: np.ndarray | None = None, rounds: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, int]:
    """Solve A x = b from products with A alone, preconditioned by its diagonal. Returns the solution and the rounds."""
    scale = 1 / np.maximum(diagonal, 1e-10) if diagonal is not None else np.ones(len(b))
    x = np.zeros(len(b)) if start is None else np.array(start, float)
    r = b - matvec(x)
    z = scale * r
    p, rz = z, float(r @ z)
    stop = tol * max(np.linalg.norm(b), 1e-300)
    for n in range(rounds):
        if np.linalg.norm(r) <= stop:
            return x, n
        ap = matvec(p)
        alpha = rz / float(p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = scale * r
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x, rounds


def stochastic_trace(matvec: Callable[[np.ndarray], np.ndarray], n: int, probes: int = 30, seed: int = 0) -> float:
    """Trace of A: the mean of z'Az over vectors of random signs."""
    rng = np.random.default_rng(seed)
    return float(np.mean([z @ matvec(z) for z in rng.choice([-1.0, 1.0], (probes, n))]))


def stochastic_logdet(matvec: Callable[[np.ndarray], np.ndarray], n: int, probes: int = 30, steps: int = 50, seed: int = 0) -> float:
    """Logarithm of the determinant of a positive definite A by Lanczos quadrature from random signs."""
    rng, total = np.random.default_rng(seed), 0.0
    for z in rng.choice([-1.0, 1.0], (probes, n)):
        basis, alphas, betas = [z / math.sqrt(n)], [], []
        for k in range(min(steps, n)):
            w = matvec(basis[-1])
            alphas.append(float(w @ basis[-1]))
            for q in basis:
                w = w - (w @ q) * q
            size = float(np.linalg.norm(w))
            if size < 1e-10 or k + 1 == min(steps, n):
                break
            betas.append(size)
            basis.append(w / size)
        t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
        theta, vectors = np.linalg.eigh(t)
        total += n * float((vectors[0] ** 2 * np.log(np.maximum(theta, 1e-300))).sum())
    return total / probes


def sparse_fit(y: np.ndarray, x: np.ndarray, matvec: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, probes: int = 30, steps: int = 50, seed: int = 0, points: int = 15) -> Components:
    """REML from products with a (sparse) relationship matrix alone: conjugate gradients for P y, quadrature for the determinant."""
    n, c = x.shape

    def at(ratio: float) -> tuple[float, float]:
        product = lambda v: ratio * matvec(v) + v
        solve = lambda b: conjugate_gradient(product, b, ratio * diagonal + 1)[0]
        vx = np.column_stack([solve(column) for column in x.T])
        gram = x.T @ vx
        residual = y - x @ np.linalg.solve(gram, vx.T @ y)
        s2 = max(float(residual @ solve(residual)) / (n - c), 1e-300)
        determinant = stochastic_logdet(product, n, probes, steps, seed)
        return -0.5 * ((n - c) * math.log(2 * math.pi * s2) + determinant + np.linalg.slogdet(gram)[1] + (n - c)), s2

    from .mixed import best_ratio

    cache: dict[float, tuple[float, float]] = {}

    def value(ratio: float) -> float:
        key = round(math.log(ratio), 3)
        if key not in cache:
            cache[key] = at(math.exp(key))
        return cache[key][0]

    ratio = math.exp(round(math.log(best_ratio(value, -5.0, 5.0, points)), 3))
    value(ratio)
    ll, s2 = cache[round(math.log(ratio), 3)]
    return Components(ratio * s2, s2, ll, len(cache), True)
