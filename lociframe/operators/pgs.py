"""Polygenic scores: scoring, validation, block values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import whole_average_rank


def score(cells: DataFrame, weights: DataFrame, missing: str = "mean") -> DataFrame:
    """Sum of weight * dosage of each sample; missing calls get the variant's mean or are left out.

    weights: (v_idx, weight); the planner broadcasts it when its size allows.
    """
    rows = cells.join(weights.select("v_idx", "weight"), "v_idx")
    if missing == "mean":
        rows = rows.withColumn("dosage", F.coalesce("dosage", F.avg("dosage").over(Window.partitionBy("v_idx"))))
    return rows.groupBy("s_idx").agg(F.sum(F.col("weight") * F.col("dosage")).alias("pgs"), F.count("dosage").alias("n_used"))


def r_squared(rows: DataFrame, y: str = "y", x: str = "pgs") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.corr(y, x).alias("pearson"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def spearman(rows: DataFrame, y: str = "y", x: str = "pgs") -> DataFrame:
    ranked = whole_average_rank(whole_average_rank(rows.select(F.col(x).alias("x"), F.col(y).alias("y")), "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("spearman"))


def auc(rows: DataFrame, status: str = "status", x: str = "pgs") -> DataFrame:
    """Area under the ROC curve from the cases' rank sum, ties averaged."""
    ranked = whole_average_rank(rows.select(F.col(status).alias("s"), F.col(x).alias("x")), "x", "rank")
    m = ranked.agg(F.sum(F.when(F.col("s") == 1, F.col("rank"))).alias("r1"), F.count(F.when(F.col("s") == 1, 1)).alias("n1"), F.count(F.when(F.col("s") == 0, 1)).alias("n0"))
    return m.select("n1", "n0", ((F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def block_values(cells: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Local breeding values: score of each (sample, block), and its variance over samples by block."""
    rows = cells.join(weights.select("v_idx", "weight"), "v_idx").join(blocks.select("v_idx", "block"), "v_idx")
    return rows.groupBy("block", "s_idx").agg(F.sum(F.col("weight") * F.col("dosage")).alias("value"))


def rhat(draws: DataFrame, within: list[str], chain: str = "chain", value: str = "value") -> DataFrame:
    """Gelman-Rubin potential scale reduction from draws of several chains."""
    own = draws.groupBy(*within, chain).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count("*").alias("n"))
    m = own.groupBy(*within).agg(F.avg("var").alias("w"), F.var_samp("mean").alias("b"), F.avg("n").alias("n"))
    pooled: Column = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    return m.select(*within, F.sqrt(pooled / F.col("w")).alias("rhat"))


def effective_size(draws: DataFrame, within: list[str], chain: str = "chain", at: str = "draw", value: str = "value") -> DataFrame:
    """Effective number of draws by Geyer's initial sequence of positive pairs of autocorrelations; one group is one parameter's chains."""
    kinds = ", ".join(f"{c} {draws.schema[c].dataType.simpleString()}" for c in within)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chains = np.stack([g.sort_values(at)[value].to_numpy(float) for _, g in group.groupby(chain)])
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in within}, "ess": [geyer(chains)], "n": [chains.size]})

    return draws.groupBy(*within).applyInPandas(run, f"{kinds}, ess double, n long")


def geyer(chains: np.ndarray) -> float:
    """Effective sample size of chains (chains x draws)."""
    m, n = chains.shape
    centred = chains - chains.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size, axis=1)
    cov = np.fft.irfft(f * np.conj(f), size, axis=1)[:, :n].mean(axis=0) / n
    within = cov[0] * n / (n - 1)
    pooled = cov[0] + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if pooled <= 0:
        return float(m * n)
    rho = 1 - (within - cov) / pooled
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
    pairs = np.minimum.accumulate(pairs[:stop])
    return float(m * n / max(-1 + 2 * pairs.sum(), 1 / (m * n)))


def converged(draws: DataFrame, within: list[str], limit: float = 1.1, least: float = 100.0) -> DataFrame:
    """(within, rhat, ess, converged): whether chains agree and hold enough effective draws."""
    both = rhat(draws, within).join(effective_size(draws, within), within)
    return both.withColumn("converged", (F.col("rhat") <= limit) & (F.col("ess") >= least))
