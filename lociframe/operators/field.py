"""A field's smooth trend inside the mixed model: a tensor-product P-spline as random effects with variances of their own.

Each direction's penalty splits its spline basis into a straight line and a smooth rest. Lines and their product
are fixed effects; the smooth rest of rows, of columns, each times the other's line, and both together are five
kernels beside the relationship, so REML weighs genetics, trend and noise together, and rows and columns may differ.

Defined cases: a direction with one place only adds nothing. Samples are plots, dense on the driver as in
`multitrait.fit_kernels`; variants are scanned in Spark with `multitrait.scan_kernels`.
"""

from __future__ import annotations

import numpy as np

from . import linalg, multitrait


def _direction(places: np.ndarray, interior: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, kernel of the smooth rest); both zero where the places don't differ."""
    t = np.asarray(places, float)
    if np.ptp(t) == 0:
        return np.zeros(len(t)), np.zeros((len(t), len(t)))
    t = (t - t.mean()) / t.std()
    basis = linalg.bspline(t, linalg.knots(t, interior, "even"), degree)
    lam, q = np.linalg.eigh(linalg.difference_penalty(basis.shape[1], 2))
    z = basis @ (q[:, 2:] / np.sqrt(lam[2:]))
    line = np.column_stack([np.ones(len(t)), t])
    z = z - line @ np.linalg.lstsq(line, z, rcond=None)[0]
    return t, z @ z.T


def parts(rows: np.ndarray, columns: np.ndarray, interior: int = 6, degree: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fixed columns and kernels of a field, kernels of mean diagonal 1; those that are nothing are left out."""
    r, kr = _direction(rows, interior, degree)
    c, kc = _direction(columns, interior, degree)
    fixed = np.column_stack([r, c, r * c])
    kernels = [kr, kc, kr * np.outer(c, c), kc * np.outer(r, r), kr * kc]
    return fixed[:, fixed.std(axis=0) > 1e-12], [k / np.trace(k) * len(k) for k in kernels if np.trace(k) > 1e-9]


def fit(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, rows: np.ndarray, columns: np.ndarray, samples: list[int], interior: int = 6) -> tuple[multitrait.KernelFit, np.ndarray]:
    """(null fit of relationship, trend and noise together, the trend of each plot without its lines' level)."""
    fixed, kernels = parts(rows, columns, interior)
    for k in range(fixed.shape[1])[::-1]:  # lines that follow from the design and the others say nothing of their own
        rest = np.column_stack([x, np.delete(fixed, k, axis=1)])
        if np.abs(fixed[:, k] - rest @ np.linalg.lstsq(rest, fixed[:, k], rcond=None)[0]).max() < 1e-8:
            fixed = np.delete(fixed, k, axis=1)
    whole = np.column_stack([x, fixed])
    found = multitrait.fit_kernels(y, whole, [kinship, *kernels], samples)
    smooth = sum(v * k for v, k in zip(found.variances[1:-1], kernels, strict=True)) @ found.py if kernels else np.zeros(len(y))
    # fixed effects are what generalised least squares leaves: y - V P y
    v = sum(s * k for s, k in zip(found.variances, [kinship, *kernels, np.eye(len(y))], strict=True))
    beta = np.linalg.lstsq(whole, y - v @ found.py, rcond=None)[0]
    return found, smooth + fixed @ beta[x.shape[1] :]
