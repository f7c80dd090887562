"""Tests of whole haplotypes in regions: counts with their uncertainty, kernels, interaction, several traits.

Haplotype calls are long rows (v_idx, s_idx, copy, allele) and regions (region, v_idx). A task holds
one region's calls of all samples; null fits are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import mixed, multitrait


def strings(haplotypes: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, s_idx, copy, hap): each copy's alleles in order of the region's variants, a dot where it has no call."""
    order = regions.groupBy("region").agg(F.array_sort(F.collect_set("v_idx")).alias("v"))
    rows = haplotypes.where("allele IS NOT NULL").join(regions, "v_idx").groupBy("region", "s_idx", "copy").agg(F.map_from_entries(F.collect_list(F.struct("v_idx", F.col("allele").cast("string")))).alias("x"))
    alleles = F.transform("v", lambda v: F.coalesce(F.element_at("x", v), F.lit(".")))
    return rows.join(order, "region").select("region", "s_idx", "copy", F.array_join(alleles, "").alias("hap"))


def counts(group: pd.DataFrame, samples: np.ndarray, rare: float = 0.02) -> tuple[list[str], np.ndarray]:
    """Names and counts (samples x haplotypes) of a region, the commonest left out and rare ones pooled as OTHER."""
    share = group["hap"].value_counts(normalize=True)
    named = group["hap"].where(group["hap"].map(share) >= rare, "OTHER")
    table = pd.crosstab(group["s_idx"], named).reindex(samples, fill_value=0)
    table = table.drop(columns=table.sum().idxmax())
    return list(table.columns), table.to_numpy(float)


def posterior_covariance(chances: np.ndarray) -> np.ndarray:
    """Summed covariance of haplotype counts from the chance of each pair of haplotypes: (samples, pairs) with pairs in order (0,0), (0,1), .. (h-1,h-1)."""
    h = int((np.sqrt(8 * chances.shape[1] + 1) - 1) / 2)
    first, second = np.triu_indices(h)
    values = np.zeros((len(first), h))
    np.add.at(values, (np.arange(len(first)), first), 1)
    np.add.at(values, (np.arange(len(first)), second), 1)
    mean = chances @ values
    return np.einsum("np,pa,pb->ab", chances, values, values) - mean.T @ mean


def score_test(d: np.ndarray, fit: mixed.NullFit, uncertainty: np.ndarray | None = None) -> tuple[float, int, float]:
    """(statistic, df, p) of haplotype counts under a null fit; posterior covariance adds the mean diagonal of P times it to the variance."""
    hd = fit.times(d)
    gx = hd.T @ fit.design
    v = d.T @ hd - gx @ fit.gram_inverse @ gx.T
    if uncertainty is not None:
        n = len(d)
        diagonal = (n - np.trace(fit.gram_inverse @ (fit.times(fit.design).T @ fit.times(fit.design))) + float((fit.shrink * (fit.vectors**2).sum(axis=0)).sum())) / n
        v = v + diagonal * uncertainty
    u = d.T @ fit.py
    rank = int(np.linalg.matrix_rank(v, tol=1e-8 * max(np.trace(v), 1e-300)))
    stat = float(u @ np.linalg.pinv(v, rcond=1e-8) @ u) / fit.sigma2_e
    return stat, rank, float(np.clip(specfun.chi2_sf(stat, float(max(rank, 1))), specfun.FLOOR, 1)) if rank else 1.0


def similarity(names: list[str], bandwidth: float = 1.0) -> np.ndarray:
    """exp(-Hamming distance / bandwidth) of haplotypes."""
    codes = np.array([list(n) for n in names])
    return np.exp(-(codes[:, None] != codes[None]).sum(axis=2) / bandwidth)


def kernel_test(d: np.ndarray, kernel: np.ndarray, fit: mixed.NullFit) -> tuple[float, float]:
    """(Q, p) of z' K z with z the haplotypes' scores: similar haplotypes have similar effects."""
    hd = fit.times(d)
    gx = hd.T @ fit.design
    v = (d.T @ hd - gx @ fit.gram_inverse @ gx.T) / fit.sigma2_e
    z = d.T @ fit.py / fit.sigma2_e
    half = np.linalg.cholesky(kernel + 1e-9 * np.eye(len(kernel)))
    q = float(z @ kernel @ z)
    return q, specfun.davies_sf(q, np.linalg.eigvalsh(half.T @ v @ half))


def adaptive_kernel_test(d: np.ndarray, names: list[str], fit: mixed.NullFit, bandwidths: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> tuple[float, float]:
    """(bandwidth, p) of the best bandwidth, by the number tried."""
    found = [(kernel_test(d, similarity(names, b), fit)[1], b) for b in bandwidths]
    p, b = min(found)
    return b, min(1.0, len(bandwidths) * p)


def interaction_tests(d: np.ndarray, z: np.ndarray, y: np.ndarray, x: np.ndarray, fit: mixed.NullFit | None = None) -> dict[str, float]:
    """p of haplotypes given interaction, of interaction, and of both: nested F tests, on whitened data if there is a mixed fit."""
    if fit is not None:
        half = np.linalg.cholesky(np.eye(len(y)) + (fit.vectors * fit.shrink) @ fit.vectors.T + 1e-10 * np.eye(len(y))).T
        d, dz, y, x = half @ d, half @ (d * z[:, None]), half @ y, half @ x
    else:
        dz = d * z[:, None]
    rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    rank = lambda m: int(np.linalg.matrix_rank(m))
    full = np.column_stack([x, d, dz])
    df = len(y) - rank(full)
    out = {}
    for name, null in (("p_main", np.column_stack([x, dz])), ("p_interact", np.column_stack([x, d])), ("p_joint", x)):
        k = rank(full) - rank(null)
        f = ((rss(null) - rss(full)) / max(k, 1)) / (rss(full) / max(df, 1))
        out[name] = float(specfun.f_sf(f, float(k), float(df))) if k and df > 0 else 1.0
    return out


def multi_test(d: np.ndarray, fit: multitrait.NullFit) -> tuple[float, int, float]:
    """(statistic, df, p) of haplotype counts on all traits or environments of a joint fit."""
    rd = fit.vectors.T @ d
    traits = fit.residual.shape[1]
    h = d.shape[1]
    pr = np.einsum("ijk,ik->ij", fit.precision, fit.residual)
    u = np.einsum("ia,ij->aj", rd, pr).ravel()
    v = np.einsum("ia,ijk,ib->ajbk", rd, fit.precision, rd).reshape(h * traits, h * traits)
    if fit.beyond is not None:
        v = v + np.kron(d.T @ d - rd.T @ rd, fit.beyond)
    cross = np.einsum("ia,ijk,ic->ajck", rd, fit.precision, fit.design).reshape(h * traits, -1)
    v = v - cross @ fit.gram_inverse @ cross.T
    rank = int(np.linalg.matrix_rank(v, tol=1e-8 * max(np.trace(v), 1e-300)))
    stat = float(u @ np.linalg.pinv(v, rcond=1e-8) @ u)
    return stat, rank, float(np.clip(specfun.chi2_sf(stat, float(max(rank, 1))), specfun.FLOOR, 1)) if rank else 1.0


def inclusion(d: np.ndarray, fit: mixed.NullFit, prior: float = 0.04) -> np.ndarray:
    """Probability that each haplotype is the one with an effect, by approximate Bayes factors of single effects."""
    hd = fit.times(d)
    gx = hd.T @ fit.design
    info = ((d * hd).sum(axis=0) - np.einsum("ij,jk,ik->i", gx, fit.gram_inverse, gx)) / fit.sigma2_e
    var = 1 / np.maximum(info, 1e-12)
    beta = d.T @ fit.py / fit.sigma2_e * var
    shrink = prior / (prior + var)
    log = 0.5 * np.log1p(-shrink) + 0.5 * shrink * beta**2 / var
    e = np.exp(log - log.max())
    return e / e.sum()


def by_region(haplotypes: DataFrame, regions: DataFrame, samples: list[int], state, work: Callable[[list[str], np.ndarray, object], dict], schema: str, rare: float = 0.02) -> DataFrame:
    """``work(names, counts, state)`` on each region; state is broadcast. The result has region, n_haplotypes and the columns that work returns."""
    shared = haplotypes.sparkSession.sparkContext.broadcast((np.array(sorted(samples)), state))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order, held = shared.value
        names, d = counts(group, order, rare)
        found = work(names, d, held) if d.shape[1] else {}
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame([{"region": group["region"].iloc[0], "n_haplotypes": d.shape[1] + 1} | {c: found.get(c) for c in columns}])

    return strings(haplotypes, regions).groupBy("region").applyInPandas(run, f"region string, n_haplotypes long, {schema}")


def scan(haplotypes: DataFrame, regions: DataFrame, fit: mixed.NullFit, rare: float = 0.02) -> DataFrame:
    """(region, n_haplotypes, stat, df, p, p_kernel): score test of the counts and adaptive kernel test."""

    def work(names: list[str], d: np.ndarray, fit: mixed.NullFit) -> dict:
        stat, df, p = score_test(d, fit)
        own = [n for n in names if n != "OTHER"]
        at = [k for k, n in enumerate(names) if n != "OTHER"]
        kernel = adaptive_kernel_test(d[:, at], own, fit)[1] if own else None
        return {"stat": stat, "df": df, "p": p, "p_kernel": kernel}

    return by_region(haplotypes, regions, list(fit.samples), fit, work, "stat double, df long, p double, p_kernel double", rare)


def scan_interaction(haplotypes: DataFrame, regions: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, z: np.ndarray, fit: mixed.NullFit | None = None, rare: float = 0.02) -> DataFrame:
    """(region, n_haplotypes, p_main, p_interact, p_joint)."""
    return by_region(haplotypes, regions, samples, (z, y, x, fit), lambda names, d, s: interaction_tests(d, *s), "p_main double, p_interact double, p_joint double", rare)


def scan_joint(haplotypes: DataFrame, regions: DataFrame, fit: multitrait.NullFit, rare: float = 0.02) -> DataFrame:
    """(region, n_haplotypes, stat, df, p) over the traits or environments of a joint fit."""
    return by_region(haplotypes, regions, list(fit.samples), fit, lambda names, d, f: dict(zip(("stat", "df", "p"), multi_test(d, f), strict=True)), "stat double, df long, p double", rare)
