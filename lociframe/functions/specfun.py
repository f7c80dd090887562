"""Tail functions of the usual distributions in numpy, vectorised, and as pandas UDFs.

Continued fractions run to convergence in log space where tails are tiny; results are clipped to
[1e-300, 1] where a p-value is wanted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
FLOOR = 1e-300


def norm_sf(x) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def norm_cdf(x) -> np.ndarray:
    return norm_sf(-np.asarray(x, float))


def norm_pdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_ppf(p) -> np.ndarray:
    """Quantile of the normal: a start from the tail's asymptote or the centre, then Newton steps in log space."""
    p = np.atleast_1d(np.asarray(p, float))
    low = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(low))
        x = t - (np.log(np.maximum(t, 1e-9) * math.sqrt(2 * math.pi)) / np.maximum(t, 1.0))
        x = np.where(low > 0.1, (0.5 - low) * math.sqrt(2 * math.pi), x)
        for _ in range(60):
            tail = norm_sf(x)
            step = (np.log(tail) - np.log(low)) * tail / norm_pdf(x)
            x = x + np.clip(step, -1, 1)
    x = np.where(p < 0.5, -x, x)
    return np.where(p == 0.5, 0.0, np.where((p <= 0) | (p >= 1), np.where(p <= 0, -np.inf, np.inf), x))


def gamma_q(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    pos = x > 0
    small, large = pos & (x < a + 1), pos & (x >= a + 1)
    if small.any():
        aa, xx = a[small], x[small]
        term = total = 1 / aa
        for k in range(1, 2000):
            term = term * xx / (aa + k)
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[small] = 1 - total * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    if large.any():
        aa, xx = a[large], x[large]
        b = xx + 1 - aa
        c, d = np.full(aa.shape, 1e300), 1 / b
        h = d
        for k in range(1, 2000):
            an = -k * (k - aa)
            b = b + 2
            d = 1 / _away(an * d + b)
            c = _away(b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[large] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def beta_i(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones(a.shape), 1 / _away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 3000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / _away(1 + up * d)
        c = _away(1 + up / c)
        h = h * d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / _away(1 + down * d)
        c = _away(1 + down / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(x <= 0, 0.0, front * h)
    return np.where(turned, 1 - value, value)


def chi2_sf(stat, df) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.maximum(np.asarray(stat, float), 0) / 2)


def f_sf(stat, df1, df2) -> np.ndarray:
    stat = np.maximum(np.asarray(stat, float), 0)
    return np.clip(beta_i(np.asarray(df2, float) / 2, np.asarray(df1, float) / 2, df2 / (df2 + df1 * stat)), FLOOR, 1)


def t_sf2(stat, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    stat = np.asarray(stat, float)
    return beta_i(np.asarray(df, float) / 2, 0.5, df / (df + stat * stat))


def liu_sf(q, weights: np.ndarray) -> float:
    """Tail of a weighted sum of chi-squares by matching moments."""
    c1, c2, c3 = weights.sum(), 2 * (weights**2).sum(), 8 * (weights**3).sum()
    if c2 <= 0:
        return 1.0
    df = 8 / (c3 / c2**1.5) ** 2
    return float(np.clip(chi2_sf((q - c1) / math.sqrt(c2) * math.sqrt(2 * df) + df, df), FLOOR, 1))


def davies_sf(q: float, weights: np.ndarray, points: int = 4000) -> float:
    """Tail of a weighted sum of chi-squares by inverting its characteristic function (Imhof's integral)."""
    w = np.asarray(weights, float)
    w = w[np.abs(w) > 1e-12 * np.abs(w).max()] if len(w) else w
    if not len(w):
        return 1.0
    scale = np.abs(w).sum()
    w, q = w / scale, q / scale
    # u = v / (1 - v) maps the half line to [0, 1)
    v = (np.arange(points) + 0.5) / points
    u = v / (1 - v)
    theta = 0.5 * np.arctan(np.outer(u, w)).sum(axis=1) - 0.5 * q * u
    rho = np.exp(0.25 * np.log1p(np.outer(u, w) ** 2).sum(axis=1))
    return float(np.clip(0.5 + (np.sin(theta) / (u * rho) / (1 - v) ** 2).sum() / points / math.pi, 0, 1))


@F.pandas_udf(DoubleType())
def chi2_sf_udf(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(stat.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_sf_udf(stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(stat.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_sf2_udf(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(stat.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_ppf_udf(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_cdf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf(x.to_numpy(float)))
