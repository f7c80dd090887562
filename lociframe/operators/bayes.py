"""Fine-mapping and polygenic weights from z-scores and LD, one LD block per group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variants of an LD block at most: its matrix of correlations is dense in one task.
MOST_VARIANTS = 10_000


def best_prior(z: np.ndarray, n: float, start: float = 0.04, widest: float = 100.0) -> float:
    """The prior variance of a single effect with the largest marginal likelihood over variants: grids on its logarithm, each finer around the best; 0 if none beats no effect."""

    def likelihood(logs: np.ndarray) -> np.ndarray:
        v = np.exp(logs)[:, None]
        s2 = 1 / (1 / v + n)
        lbf = 0.5 * np.log(s2 / v) + 0.5 * s2 * n * z * z
        top = lbf.max(axis=1, keepdims=True)
        return top[:, 0] + np.log(np.exp(lbf - top).mean(axis=1))

    low, high = np.log(1e-8), np.log(max(widest * start, float((z * z).max() / n)))
    for _ in range(5):
        grid = np.linspace(low, high, 25)
        values = likelihood(grid)
        k = int(values.argmax())
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    return float(np.exp(grid[k])) if values[k] > 0 else 0.0


def susie_rss(z: np.ndarray, r: np.ndarray, n: float, layers: int = 10, prior: float | None = None, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Sum of single effects on z-scores: (pip, alpha by layer), by coordinate ascent.

    Each layer's prior variance is estimated in each round unless given; a layer whose best is 0
    has no effect and no part in the inclusion probabilities.
    """
    m = len(z)
    z = z * np.sqrt((n - 1) / (z * z + n - 2))
    alpha, mean = np.full((layers, m), 1.0 / m), np.zeros((layers, m))
    variances = np.full(layers, prior or 0.0)
    fitted = np.zeros(m)
    for _ in range(rounds):
        before = alpha.copy()
        for k in range(layers):
            fitted -= r @ (alpha[k] * mean[k])
            left = z / np.sqrt(n) - fitted
            v = variances[k] = prior if prior is not None else best_prior(left * np.sqrt(n), n)
            if v == 0:
                alpha[k], mean[k] = 1.0 / m, 0.0
                continue
            s2 = 1.0 / (1.0 / v + n)
            mu = s2 * n * left
            log_bf = 0.5 * np.log(s2 / v) + 0.5 * mu * mu / s2
            e = np.exp(log_bf - log_bf.max())
            alpha[k], mean[k] = e / e.sum(), mu
            fitted += r @ (alpha[k] * mean[k])
        if np.abs(alpha - before).max() < tol:
            break
    return 1 - np.prod(1 - alpha[variances > 0], axis=0), alpha


def ldpred_inf(z: np.ndarray, r: np.ndarray, n: float, h2: float, m_total: int) -> np.ndarray:
    """Infinitesimal weights: a ridge on the LD matrix."""
    return np.linalg.solve(r + m_total / (n * h2) * np.eye(len(z)), z / np.sqrt(n))


def ldpred_gibbs(z: np.ndarray, r: np.ndarray, n: float, h2: float, p: float, m_total: int, draws: int = 200, burn_in: int = 50, seed: int = 0, learn: bool = False) -> tuple[np.ndarray, float, float]:
    """Point-normal weights by Gibbs sampling; ``learn`` also draws p and h2."""
    rng = np.random.default_rng(seed)
    m, b = len(z), z / np.sqrt(n)
    w, kept, fitted = np.zeros(m), np.zeros(m), np.zeros(m)
    for it in range(draws + burn_in):
        slab = h2 / max(m_total * p, 1e-12)
        shrink = 1.0 / (n + 1.0 / slab)
        active = 0
        mean_draw = np.zeros(m)
        for j in range(m):
            left = b[j] - (fitted[j] - r[j, j] * w[j])
            mu = n * left * shrink
            odds = np.log(p / (1 - p)) + 0.5 * np.log(shrink / slab) + 0.5 * mu * mu / shrink
            chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            new = mu + np.sqrt(shrink) * rng.standard_normal() if rng.random() < chance else 0.0
            active += new != 0.0
            mean_draw[j] = chance * mu
            if new != w[j]:
                fitted += r[:, j] * (new - w[j])
                w[j] = new
        if learn:
            p = float(np.clip(rng.beta(1 + active, 1 + m - active), 1e-5, 0.999))
            h2 = float(np.clip(w @ r @ w, 1e-4, 1.0))
        if it >= burn_in:
            kept += mean_draw
    return kept / draws, p, h2


def _gig(rng: np.random.Generator, lam: float, chi: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Generalised inverse Gaussian draws, exact by rejection from the log-concave density of the log."""
    omega = np.sqrt(np.maximum(chi * psi, 1e-16))
    scale = np.sqrt(np.maximum(chi, 1e-16) / np.maximum(psi, 1e-16))
    out = np.empty(len(omega))
    for k, w in enumerate(omega):
        # density of t = log x is exp(lam t - w cosh t), mode at sinh t = lam / w
        mode = np.arcsinh(lam / w)
        f = lambda t: lam * (t - mode) - w * (np.cosh(t) - np.cosh(mode))
        # points where the log density fell by one bound it by a constant and two exponentials
        sides = []
        for sign in (-1, 1):
            low, high = 0.0, 1e-3
            while f(mode + sign * high) > -1:
                low, high = high, high * 2
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (mid, high) if f(mode + sign * mid) > -1 else (low, mid)
            slope = abs(lam - w * np.sinh(mode + sign * high))
            sides.append((high, slope))
        (a, sa), (b, sb) = sides
        mass = np.array([np.exp(-1) / sa, a + b, np.exp(-1) / sb])
        while True:
            part = rng.choice(3, p=mass / mass.sum())
            if part == 1:
                t, bound = mode + rng.uniform(-a, b), 0.0
            else:
                sign, edge, slope = (-1, a, sa) if part == 0 else (1, b, sb)
                e = rng.exponential(1 / slope)
                t, bound = mode + sign * (edge + e), -1 - slope * e
            if np.log(rng.random()) <= f(t) - bound:
                out[k] = scale[k] * np.exp(t)
                break
    return out


def prs_cs(z: np.ndarray, r: np.ndarray, n: float, a: float = 1.0, b: float = 0.5, phi: float = 1e-2, draws: int = 100, burn_in: int = 50, seed: int = 0) -> np.ndarray:
    """Continuous-shrinkage weights: global-local prior, one multivariate draw for each sweep."""
    rng = np.random.default_rng(seed)
    m, y = len(z), z / np.sqrt(n)
    psi, kept = np.full(m, phi), np.zeros(m)
    for it in range(draws + burn_in):
        chol = np.linalg.cholesky(r + np.diag(1 / np.clip(psi, 1e-12, 1.0)))
        beta = np.linalg.solve(chol.T, np.linalg.solve(chol, y) + rng.standard_normal(m) / np.sqrt(n))
        delta = rng.gamma(a + b, 1 / (psi + phi))
        psi = np.minimum(_gig(rng, a - 0.5, n * beta**2, 2 * delta), 1.0)
        if it >= burn_in:
            kept += beta
    return kept / draws


def correlation_matrix(v: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray, shrink: float = 0.0) -> np.ndarray:
    out = np.eye(len(v))
    a, b = np.searchsorted(v, i), np.searchsorted(v, j)
    out[a, b] = out[b, a] = r
    return (1 - shrink) * out + shrink * np.eye(len(v))


def by_block(stats: DataFrame, pairs: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, shrink: float = 0.1) -> DataFrame:
    """``work`` on each LD block's rows (v_idx, block, z, n) and correlation matrix.

    Both tables are grouped by block in one cogroup; a block's size bounds a task, so it is checked.
    Blocks of few variants come from `ld_cuts.blocks`.
    """
    largest = stats.groupBy("block").count().orderBy(F.desc("count"), "block").first()
    if largest and largest["count"] > MOST_VARIANTS:
        raise ValueError(f"block {largest['block']} has {largest['count']} variants; cut blocks of at most {MOST_VARIANTS}")
    blocks = stats.select("v_idx", "block")
    inside = pairs.join(blocks.withColumnsRenamed({"v_idx": "i"}), "i").join(blocks.withColumnsRenamed({"v_idx": "j", "block": "other"}), "j")
    inside = inside.where("block = other").select(F.col("block").alias("of_block"), "i", "j", "r")

    def run(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v_idx").reset_index(drop=True)
        return work(rows, correlation_matrix(rows["v_idx"].to_numpy(), links["i"].to_numpy(), links["j"].to_numpy(), links["r"].to_numpy(), shrink))

    return stats.groupBy("block").cogroup(inside.groupBy("of_block")).applyInPandas(run, schema)


def finemap(stats: DataFrame, pairs: DataFrame, layers: int = 10) -> DataFrame:
    """(block, v_idx, pip) of each block."""
    work = lambda rows, r: pd.DataFrame({"block": rows["block"], "v_idx": rows["v_idx"], "pip": susie_rss(rows["z"].to_numpy(), r, float(rows["n"].mean()), layers)[0]})
    return by_block(stats, pairs, work, "block string, v_idx long, pip double")


def polygenic_weights(stats: DataFrame, pairs: DataFrame, method: str = "inf", h2: float = 0.3, p: float = 0.1, m_total: int | None = None) -> DataFrame:
    """(block, v_idx, weight) by LDpred2 (inf, grid, auto) or PRS-CS (cs); seeded by block. m_total is the number of variants of stats unless given."""
    m_total = m_total or max(1, stats.count())

    def work(rows: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        z, n = rows["z"].to_numpy(), float(rows["n"].mean())
        seed = int(rows["v_idx"].iloc[0])
        if method == "inf":
            w = ldpred_inf(z, r, n, h2, m_total)
        elif method in ("grid", "auto"):
            w = ldpred_gibbs(z, r, n, h2, p, m_total, seed=seed, learn=method == "auto")[0]
        elif method == "cs":
            w = prs_cs(z, r, n, seed=seed)
        else:
            raise ValueError(f"unknown method {method}")
        return pd.DataFrame({"block": rows["block"], "v_idx": rows["v_idx"], "weight": w})

    return by_block(stats, pairs, work, "block string, v_idx long, weight double")


def hess(stats: DataFrame, pairs: DataFrame, least: float = 1.0) -> DataFrame:
    """(block, h2, se): local heritability from the block's leading eigenvectors."""

    def work(rows: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        d, u = np.linalg.eigh(r)
        keep = d >= least
        n = float(rows["n"].mean())
        q = float((((u[:, keep].T @ rows["z"].to_numpy()) ** 2) / d[keep]).sum())
        return pd.DataFrame({"block": rows["block"].iloc[:1], "h2": [(q - keep.sum()) / n], "se": [np.sqrt(2 * (1 / d[keep] ** 2).sum()) / n], "n_kept": [int(keep.sum())]})

    return by_block(stats, pairs, work, "block string, h2 double, se double, n_kept long", shrink=0.0)


def hess_covariance(first: DataFrame, second: DataFrame, pairs: DataFrame, least: float = 1.0) -> DataFrame:
    """(block, covariance): local genetic covariance of two traits (v_idx, block, z, n) from the block's leading eigenvectors."""
    both = first.select("v_idx", "block", "z", "n").join(second.select("v_idx", F.col("z").alias("z2"), F.col("n").alias("n2")), "v_idx")

    def work(rows: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        d, u = np.linalg.eigh(r)
        keep = d >= least
        n = float(np.sqrt(rows["n"].mean() * rows["n2"].mean()))
        q = float(((u[:, keep].T @ rows["z"].to_numpy()) * (u[:, keep].T @ rows["z2"].to_numpy()) / d[keep]).sum())
        return pd.DataFrame({"block": rows["block"].iloc[:1], "covariance": [q / n], "n_kept": [int(keep.sum())]})

    return by_block(both, pairs, work, "block string, covariance double, n_kept long", shrink=0.0)


def ldsc(rows: DataFrame, m_total: float, n_blocks: int = 200, steps: int = 2) -> DataFrame:
    """LD score regression with reweighting and a block jackknife.

    rows: (at, chi2, ld_score, n) with ``at`` the genome order. Spark reduces each jackknife block
    to 2 x 2 moments per step; the driver solves n_blocks small systems.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    total = rows.agg(F.count("*").alias("m"), F.avg("n").alias("nbar"), F.avg("chi2").alias("mean"), F.avg(F.col("ld_score") * F.col("n")).alias("ln"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    nbar = total["nbar"]
    from lociframe.operators.ranking import with_rank

    # the even buckets of the ranking, over the genome's own range
    even = 1 / 64 + (F.col("at") - (total["low"] or 0)) * (63 / 64 / ((total["high"] or 0) - (total["low"] or 0) + 1))
    placed = with_rank(rows.withColumn("__u", even), "__u", ["at"])
    block = F.least(F.floor((F.col("i") - 1) / (F.col("m") / n_blocks)), F.lit(n_blocks - 1)).cast("int")
    placed = placed.withColumn("block", block).select("block", "chi2", "ld_score", "n")
    a, h2 = 1.0, max(m_total * (total["mean"] - 1) / total["ln"], 0.0)
    x = F.col("ld_score") * F.col("n") / nbar
    moments = None
    for _ in range(steps):
        w = 1 / (2 * F.pow(F.lit(a) + h2 * F.col("n") * F.greatest("ld_score", F.lit(1.0)) / m_total, 2)) / F.greatest("ld_score", F.lit(1.0))
        got = placed.groupBy("block").agg(*(F.sum(w * e).alias(k) for k, e in (("s0", F.lit(1.0)), ("sx", x), ("sxx", x * x), ("sy", F.col("chi2")), ("sxy", x * F.col("chi2"))))).collect()
        moments = np.array([[r["s0"], r["sx"], r["sxx"], r["sy"], r["sxy"]] for r in got])
        intercept, slope = _line(moments.sum(axis=0))
        a, h2 = intercept, max(slope * m_total / nbar, 0.0)
    rows.unpersist()
    k = len(moments)
    whole = np.array(_line(moments.sum(axis=0)))
    left = np.array([_line(moments.sum(axis=0) - m) for m in moments])
    pseudo = k * whole - (k - 1) * left
    se = np.sqrt(pseudo.var(axis=0, ddof=1) / k)
    return spark.createDataFrame([(float(whole[1] * m_total / nbar), float(se[1] * m_total / nbar), float(whole[0]), float(se[0]))], "h2 double, h2_se double, intercept double, intercept_se double")


def _line(m: np.ndarray) -> tuple[float, float]:
    s0, sx, sxx, sy, sxy = m
    det = s0 * sxx - sx * sx
    return (sxx * sy - sx * sxy) / det, (s0 * sxy - sx * sy) / det
