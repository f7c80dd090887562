"""Cross-trait and partitioned LD score regression, ancestry meta-regression, dependent-test combination, neighbour and HMM imputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import specfun


def ldsc_covariance(rows: DataFrame, m_total: float) -> DataFrame:
    """Genetic covariance and correlation from paired scores (z1, z2, n1, n2, ld_score), unweighted.

    Three regressions on the LD score share one aggregation.
    """
    n12 = F.sqrt(F.col("n1") * F.col("n2"))
    l = F.col("ld_score")
    m = rows.agg(
        F.regr_slope(F.col("z1") * F.col("z2"), n12 * l).alias("s12"), F.regr_slope(F.col("z1") * F.col("z1"), F.col("n1") * l).alias("s1"), F.regr_slope(F.col("z2") * F.col("z2"), F.col("n2") * l).alias("s2"),
        F.regr_intercept(F.col("z1") * F.col("z2"), n12 * l).alias("intercept"),
    )
    cov, h1, h2 = F.col("s12") * m_total, F.col("s1") * m_total, F.col("s2") * m_total
    return m.select(cov.alias("covariance"), h1.alias("h2_1"), h2.alias("h2_2"), (cov / F.sqrt(F.abs(h1 * h2))).alias("rg"), "intercept")


def partitioned_heritability(rows: DataFrame, annotations: list[str], sizes: dict[str, float]) -> DataFrame:
    """Stratified regression of chi2 on n times each annotation's LD score; rows: (chi2, n, annotation columns).

    Spark reduces to the normal equations; the driver solves a system in the number of annotations.
    """
    x = {a: F.col("n") * F.col(a) for a in annotations} | {"__one": F.lit(1.0)}
    total = sum((F.col(a) for a in annotations), F.lit(0.0))
    w = 1 / F.greatest(total, F.lit(1.0))
    names = list(x)
    sums = rows.agg(*(F.sum(w * x[a] * x[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)), *(F.sum(w * x[a] * F.col("chi2")).alias(f"y_{i}") for i, a in enumerate(names))).first()
    k = len(names)
    tau = np.linalg.pinv(np.array([[sums[f"{i}_{j}"] for j in range(k)] for i in range(k)])) @ np.array([sums[f"y_{i}"] for i in range(k)])
    h2 = {a: float(tau[i] * sizes[a]) for i, a in enumerate(annotations)}
    whole, m = sum(h2.values()), sum(sizes.values())
    out = [(a, float(tau[i]), h2[a], (h2[a] / whole) / (sizes[a] / m) if whole else None) for i, a in enumerate(annotations)]
    return rows.sparkSession.createDataFrame(out, "annotation string, tau double, h2 double, enrichment double")


def ancestry_axes(frequencies: DataFrame, studies: list[str], n_axes: int = 1) -> np.ndarray:
    """Leading axes of the studies' allele-frequency correlation; frequencies: one column for each study. Studies are few."""
    k = len(studies)
    if n_axes > k - 2:
        raise ValueError("too many axes for the number of studies")
    row = frequencies.agg(*(F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(studies) for j, b in enumerate(studies))).first()
    c = np.nan_to_num(np.array([[row[f"c{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)], float))
    centred = c - c.mean(axis=0) - c.mean(axis=1)[:, None] + c.mean()
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:n_axes]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def mr_mega(rows: DataFrame, studies: list[str], axes: np.ndarray, by: str = "snp") -> DataFrame:
    """Meta-regression of each variant's effects on ancestry axes; rows: (by, study, beta, se). Variants in all studies only."""
    order = {s: k for k, s in enumerate(studies)}
    lists = rows.groupBy(by).agg(F.collect_list(F.struct("study", "beta", "se")).alias("x")).where(F.size("x") == len(studies))
    x = np.column_stack([np.ones(len(studies)), axes])

    def run(stream):
        for batch in stream:
            out = []
            for own in batch["x"]:
                own = sorted(own, key=lambda r: order[r["study"]])
                b, w = np.array([r["beta"] for r in own]), 1 / np.array([r["se"] for r in own]) ** 2
                coef = np.linalg.pinv(x.T @ (w[:, None] * x)) @ (x.T @ (w * b))
                residual = float((w * (b - x @ coef) ** 2).sum())
                plain = float((w * (b - (w * b).sum() / w.sum()) ** 2).sum())
                out.append((float(coef[0]), plain, residual, plain - residual, float((w * b * b).sum()) - residual))
            t = np.array(out).reshape(-1, 5)
            k, a = len(studies), axes.shape[1]
            yield pd.DataFrame({
                by: batch[by], "beta": t[:, 0], "p_association": specfun.chi2_sf(t[:, 4], float(a + 1)), "p_ancestry": specfun.chi2_sf(t[:, 3], float(a)),
                "p_residual": specfun.chi2_sf(t[:, 2], float(k - 1 - a)) if k - 1 - a > 0 else np.ones(len(t)),
            })

    kind = rows.schema[by].dataType.simpleString()
    return lists.mapInPandas(run, f"{by} {kind}, beta double, p_association double, p_ancestry double, p_residual double")


def brown(p: np.ndarray, correlation: np.ndarray) -> float:
    """Fisher's statistic with its variance widened for correlated tests, as a scaled chi-square."""
    k = len(p)
    r = np.abs(correlation)
    cov = 3.263 * r + 0.710 * r**2 + 0.027 * r**3
    np.fill_diagonal(cov, 4.0)
    mean, var = 2.0 * k, float(cov.sum())
    scale, df = var / (2 * mean), 2 * mean * mean / var
    stat = float(-2 * np.log(np.maximum(p, 1e-300)).sum())
    return float(np.clip(specfun.chi2_sf(stat / scale, df), specfun.FLOOR, 1))


def impute_knn(cells: DataFrame, kinship: DataFrame, k: int = 5) -> DataFrame:
    """Missing calls from the k most related samples (s_idx, other, w), weighted by relationship; else the variant's mean."""
    place = F.row_number().over(Window.partitionBy("s_idx").orderBy(F.col("w").desc(), "other"))
    near = kinship.where("s_idx <> other").withColumn("place", place).where(F.col("place") <= k).drop("place")
    known = cells.where("dosage IS NOT NULL").select("v_idx", F.col("s_idx").alias("other"), "dosage")
    missing = cells.where("dosage IS NULL").select("v_idx", "s_idx")
    sums = missing.join(near, "s_idx").join(known, ["v_idx", "other"]).groupBy("v_idx", "s_idx").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("dosage")).alias("wd"), F.sum(F.greatest("w", F.lit(0.0))).alias("w"), F.avg("dosage").alias("plain"))
    guess = sums.select("v_idx", "s_idx", F.when(F.col("w") > 0, F.col("wd") / F.col("w")).otherwise(F.col("plain")).alias("guess"))
    means = cells.groupBy("v_idx").agg(F.avg("dosage").alias("mean"))
    return cells.join(guess, ["v_idx", "s_idx"], "left").join(means, "v_idx").select("v_idx", "s_idx", F.coalesce("dosage", "guess", "mean").alias("dosage"))


#: States of all sites that `copying_posterior` holds at once, of some samples.
COPIED = 4_000_000


def copying_posterior(g: np.ndarray, switch: float = 0.05, error: float = 0.02, ploidy: int = 2) -> np.ndarray:
    """Expected dosages under a copying model: each sample is a mosaic of the others (rows samples, columns sites, NaN missing).

    Samples with the same calls are one state that counts as often as there are of them, and get the same dosages.
    """
    n, m = g.shape
    out = g.copy()
    gone = np.isnan(g).any(axis=1)
    if not gone.any():
        return out
    known = ~np.isnan(g)
    mean = np.where(known, g, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    if n == 1:
        return np.where(known, g, mean)
    # a call's level at its site, the last for one that is missing
    level, levels = np.empty(g.shape, np.int32), []
    for t in range(m):
        own, at = np.unique(g[known[:, t], t], return_inverse=True)
        level[:, t] = len(own)
        level[known[:, t], t] = at
        levels.append(own)
    rows, of, counts = np.unique(level, axis=0, return_inverse=True, return_counts=True)
    of, u, counts = of.ravel(), len(rows), counts.astype(float)
    filled = np.stack([np.append(own, mean[t])[rows[:, t]] for t, own in enumerate(levels)])
    fits = [np.vstack([*(np.exp(-np.abs(filled[t] - v) / ploidy * np.log((1 - error) / error)) for v in own), np.ones(u)]) for t, own in enumerate(levels)]
    asked = np.unique(of[gone])
    done = np.zeros((u, m))
    step = max(1, COPIED // (u * m))
    for a in range(0, len(asked), step):
        who = asked[a : a + step]
        at, alone = np.arange(len(who)), counts[who] == 1

        def fit_of(t: int, who: np.ndarray = who, at: np.ndarray = at, alone: np.ndarray = alone) -> np.ndarray:
            f = fits[t][rows[who, t]]
            f[at[alone], who[alone]] = 0.0  # a sample does not copy from itself
            return f

        # of a state with others, all but the sample itself
        over = lambda x: (x @ counts - np.where(alone, 0.0, x[at, who]))[:, None]  # noqa: B023, E731
        forward = np.empty((m, len(who), u))
        for t in range(m):
            f = fit_of(t)
            if t:
                f *= (1 - switch) * forward[t - 1] + switch / (n - 1)
            np.divide(f, over(f), out=forward[t])
        b = np.ones((len(who), u))
        for t in range(m - 1, -1, -1):
            if t < m - 1:
                b *= fit_of(t + 1)
                share = switch * over(b) / (n - 1)
                b *= 1 - switch
                b += share
                b /= (b @ counts)[:, None]
            need = np.flatnonzero(rows[who, t] == len(levels[t]))
            if len(need):
                post = forward[t][need] * b[need]
                own = post[np.arange(len(need)), who[need]].copy()
                post *= counts
                post[np.arange(len(need)), who[need]] -= own
                done[who[need], t] = (post @ filled[t]) / post.sum(axis=1)
    return np.where(known, g, done[of])


def impute_copying(cells: DataFrame, variants: DataFrame, window: int = 50_000) -> DataFrame:
    """`copying_posterior` in windows of positions; a task holds one window of all samples."""
    placed = cells.join(variants.select("v_idx", "chr", "pos"), "v_idx").withColumn("block", F.floor(F.col("pos") / window))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = group[["v_idx", "pos"]].drop_duplicates().sort_values(["pos", "v_idx"])["v_idx"]
        wide = group.pivot(index="s_idx", columns="v_idx", values="dosage")[order.tolist()]
        done = pd.DataFrame(copying_posterior(wide.to_numpy(float)), index=wide.index, columns=wide.columns)
        return done.stack().rename("dosage").reset_index()[["v_idx", "s_idx", "dosage"]]

    return placed.groupBy("chr", "block").applyInPandas(run, "v_idx long, s_idx long, dosage double")
