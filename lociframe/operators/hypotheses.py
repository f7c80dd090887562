"""Tests of estimates, tails of mixtures, and corrections that adapt to the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import glm
from .packed import map_variants, pack


def wald(beta: np.ndarray, se: np.ndarray, df: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, p): chi-square with one degree of freedom, or F with df in the denominator."""
    stat = (np.asarray(beta) / np.asarray(se)) ** 2
    return stat, specfun.chi2_sf(stat, 1.0) if df is None else specfun.f_sf(stat, 1.0, df)


def likelihood_ratio(null: np.ndarray, alternative: np.ndarray, df: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    stat = np.maximum(2 * (np.asarray(alternative) - np.asarray(null)), 0)
    return stat, specfun.chi2_sf(stat, df)


def score(u: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Joint score test: u' V^-1 u, chi-square in the rank of V."""
    u, v = np.atleast_1d(u), np.atleast_2d(v)
    stat = float(u @ np.linalg.pinv(v) @ u)
    return stat, float(specfun.chi2_sf(stat, float(np.linalg.matrix_rank(v))))


def contrast(beta: np.ndarray, cov: np.ndarray, c: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, df) of C beta = 0."""
    c = np.atleast_2d(c)
    value, rank = c @ beta, int(np.linalg.matrix_rank(c))
    stat = float(value @ np.linalg.pinv(c @ cov @ c.T) @ value)
    return stat, float(specfun.chi2_sf(stat, float(rank))), rank


def mixture_tail(q: float, weights: np.ndarray, method: str = "davies") -> float:
    """Tail of a weighted sum of chi-squares, by inversion (davies) or moments (liu); inversion's failures fall back to moments."""
    if method == "liu":
        return specfun.liu_sf(q, weights)
    p = specfun.davies_sf(q, weights)
    return p if 1e-10 < p <= 1 else specfun.liu_sf(q, weights)


def effective_tests(values: np.ndarray, share: float = 0.995) -> dict[str, float]:
    """Effective numbers of tests from the eigenvalues of a correlation matrix: the number that reach a share, and Moskvina and Schmidt's."""
    values = np.sort(np.maximum(values, 0))[::-1]
    m = len(values)
    moskvina = 1 + (m - 1) * (1 - values.var(ddof=1) / m) if m > 1 else 1.0
    return {"simple": float(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1), "moskvina": float(np.clip(moskvina, 1, m))}


def inflation(rows: DataFrame, p: str = "p") -> DataFrame:
    """(n, lambda_gc, share_005): the median chi-square over its expectation and the share of small p-values."""
    stat = F.pow(-specfun.norm_ppf_udf(F.least(F.greatest(F.col(p) / 2, F.lit(1e-300)), F.lit(0.5))), 2)
    m = rows.where(F.col(p).isNotNull() & ~F.isnan(p)).agg(F.count("*").alias("n"), F.percentile_approx(stat, 0.5, 100_000).alias("median"), F.avg((F.col(p) < 0.05).cast("int")).alias("share_005"))
    return m.select("n", (F.col("median") / 0.454936423119572).alias("lambda_gc"), "share_005")


def compare_p(ours: DataFrame, reference: DataFrame, by: str = "v_idx", tolerance: float = 1e-6) -> DataFrame:
    """(n, correlation, max_gap, mean_gap, share_within) of -log10 p of two scans of the same variants."""
    log = lambda c: -F.log10(F.greatest(F.col(c), F.lit(1e-300)))
    both = ours.select(by, log("p").alias("a")).join(reference.select(by, log("p").alias("b")), by)
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n"), F.corr("a", "b").alias("correlation"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.avg((gap <= tolerance).cast("int")).alias("share_within"))


def adaptive_thresholds(rows: DataFrame, covariate: str, ties: list[str], p: str = "p", q: float = 0.1, n_bins: int = 5, scalings: int = 200) -> DataFrame:
    """``rows`` with threshold and selected: p against a threshold of its covariate's bin, all scaled together as far as the mirrored share of false discoveries allows.

    A bin's shape is its share of small p-values. The share at a scaling s is (1 + number of
    p > 1 - s * shape) over the number of p <= s * shape; both counts of all scalings come from one
    aggregation by bin and scaling.
    """
    edges = rows.approxQuantile(covariate, [k / n_bins for k in range(1, n_bins)], 0.001)
    bin_ = sum((F.when(F.col(covariate) > e, 1).otherwise(0) for e in edges), F.lit(0))
    placed = rows.withColumn("__bin", bin_)
    shares = {r["__bin"]: max(r["s"], 1e-3) for r in placed.groupBy("__bin").agg(F.avg((F.col(p) < 0.1).cast("int")).alias("s")).collect()}
    mean = sum(shares.values()) / max(1, len(shares))
    shape = F.coalesce(*(F.when(F.col("__bin") == b, s / mean) for b, s in shares.items()), F.lit(1.0))
    placed = placed.withColumn("__shape", F.least(shape, F.lit(2.0)))
    grid = np.linspace(0.01, 2.0, scalings) * 0.2
    # the smallest scaling that takes a p-value in, and the largest that mirrors it
    step = grid[1] - grid[0]
    place = lambda v: F.greatest(F.ceil((v / F.col("__shape") - grid[0]) / step - 1e-9), F.lit(0)).cast("int")
    counts = placed.groupBy(place(F.col(p)).alias("k")).agg(F.count("*").alias("n")).where(F.col("k") < scalings).collect()
    mirrored = placed.groupBy(place(1 - F.col(p)).alias("k")).agg(F.count("*").alias("n")).where(F.col("k") < scalings).collect()
    taken, false = np.zeros(scalings), np.zeros(scalings)
    for r in counts:
        taken[r["k"]] += r["n"]
    for r in mirrored:
        false[r["k"]] += r["n"]
    share = (1 + np.cumsum(false)) / np.maximum(np.cumsum(taken), 1)
    good = np.flatnonzero(share <= q)
    s = float(grid[good[-1]]) if len(good) else 0.0
    return placed.withColumn("threshold", F.least(F.lit(s) * F.col("__shape"), F.lit(0.5))).withColumn("selected", (F.col("threshold") > 0) & (F.col(p) <= F.col("threshold"))).drop("__bin", "__shape")


def shrink(small: np.ndarray, large: np.ndarray, middle: np.ndarray, v: np.ndarray, q: float, refit: int = 10) -> tuple[np.ndarray, list[int]]:
    """(level of each bin, bins in the order in which they gave way) of thresholds that shrink on masked p-values.

    small and large (bins x cells) count the p and the 1 - p that fall into a cell, cells in order of
    falling v; middle counts the rest by bin. While a cell is masked only small + large may be looked
    at. The bin whose outermost cell is least likely to hold effects gives it up, until (1 + large) /
    small of what is masked is at most q. Likely is what a two-group model says, with a share of
    effects for each bin and p^(a - 1) for effects, refitted on masked pairs and revealed cells.
    """
    bins, cells = small.shape
    level, path, shape = np.zeros(bins, int), [], 0.3
    share = np.full(bins, 0.1)
    low, high = -np.log(v), -np.log1p(-v)
    half = np.array([np.log(2.0)])
    while (level < cells).any():
        masked = np.arange(cells)[None] >= level[:, None]
        if (1 + large[masked].sum()) / max(1, small[masked].sum()) <= q:
            break
        if len(path) % refit == 0:
            weights = np.concatenate([np.where(masked, small + large, 0), np.where(masked, 0, small), np.where(masked, 0, large), middle[:, None]], axis=1)
            for _ in range(20):
                a, b = np.exp((1 - shape) * low), np.exp((1 - shape) * high)
                density = shape * np.concatenate([(a + b) / 2, a, b, np.exp((1 - shape) * half)])
                depth = np.concatenate([(a * low + b * high) / (a + b), low, high, half])
                chance = share[:, None] * density / (share[:, None] * density + 1 - share[:, None])
                held = weights * chance
                share = np.clip(held.sum(axis=1) / np.maximum(weights.sum(axis=1), 1), 1e-3, 0.999)
                shape = float(np.clip(held.sum() / max((held * depth).sum(), 1e-12), 0.05, 0.95))
        at = np.minimum(level, cells - 1)
        odds = share / (1 - share) * np.exp((1 - shape) * low[at])
        path.append(int(np.where(level < cells, odds, np.inf).argmin()))
        level[path[-1]] += 1
    return level, path


def masked_thresholds(rows: DataFrame, covariate: str, p: str = "p", q: float = 0.1, n_bins: int = 5, cells: int = 120, ratio: float = 0.86) -> DataFrame:
    """``rows`` with threshold and selected: a threshold for each bin of the covariate, shrunk by `shrink` until the estimated share of false discoveries is q.

    One aggregation counts p-values by bin, side and cell (cells are geometric from 0.45 down); the
    rounds run on these counts, whose number does not grow with the data. A null p is not selected;
    a null covariate belongs to the first bin.
    """
    edges = rows.approxQuantile(covariate, [k / n_bins for k in range(1, n_bins)], 0.001)
    side = F.when(F.col(p) <= 0.45, "small").when(F.col(p) >= 0.55, "large").when(F.col(p).isNotNull(), "middle")
    depth = F.floor(F.log(F.greatest(F.least(p, 1 - F.col(p)), F.lit(1e-300)) / 0.45) / float(np.log(ratio)))
    placed = rows.withColumn("__bin", sum((F.when(F.col(covariate) > e, 1).otherwise(0) for e in edges), F.lit(0))).withColumn("__side", side)
    placed = placed.withColumn("__cell", F.greatest(F.least(depth, F.lit(cells - 1)), F.lit(0)).cast("int"))
    counts = {name: np.zeros((n_bins, cells)) for name in ("small", "large", "middle")}
    for r in placed.where("__side IS NOT NULL").groupBy("__bin", "__side", "__cell").count().collect():
        counts[r["__side"]][r["__bin"], r["__cell"]] = r["count"]
    v = 0.45 * ratio ** (np.arange(cells) + 0.5)
    level, _ = shrink(counts["small"], counts["large"], counts["middle"].sum(axis=1), v, q)
    at = F.get(F.array(*(F.lit(int(n)) for n in level)), F.col("__bin"))
    threshold = F.when(at < cells, 0.45 * F.pow(F.lit(ratio), at)).otherwise(0.0)
    selected = F.coalesce((F.col("__side") == "small") & (F.col("__cell") >= at), F.lit(False))
    return placed.withColumn("threshold", threshold).withColumn("selected", selected).drop("__bin", "__side", "__cell")


def adaptive_max(cells: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, first: int = 100, most: int = 1000, enough: int = 10, seed: int = 0) -> DataFrame:
    """Family-wise p of each variant by the largest squared correlation under permutation: ``first`` rounds for all, the rest only if some variant is not yet decided.

    (v_idx, r2, p_fwer, n_permutations). Blocks of variants give their maxima under shared
    permutations, which combine by maximum; a variant with ``enough`` larger maxima is decided.
    """
    packed = pack(cells).persist()

    def blocks(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        own = glm.permutation_max(g, s["y"], s["x"], s["n"], s["seed"])
        q, _ = np.linalg.qr(s["x"])
        ry, rg = s["y"] - q @ (q.T @ s["y"]), g - q @ (q.T @ g)
        r2 = (rg.T @ ry) ** 2 / np.maximum((rg * rg).sum(axis=0) * (ry @ ry), 1e-300)
        return {"r2": r2, "maxima": [own.tolist()] + [None] * (g.shape[1] - 1)}

    null = np.zeros(0)
    done, rows = 0, None
    while done < most:
        n = first if not done else most - done
        rows = map_variants(packed, samples, blocks, {"y": y, "x": x, "n": n, "seed": seed + done}, "r2 double, maxima array<double>").persist()
        got = rows.where("maxima IS NOT NULL").select(F.posexplode("maxima").alias("k", "m")).groupBy("k").agg(F.max("m").alias("m")).orderBy("k").collect()
        null = np.concatenate([null, [r["m"] for r in got]])
        done += n
        cut = np.sort(null)[-enough] if len(null) >= enough else -1.0
        if done < most and not rows.where(F.col("r2") > float(cut)).limit(1).count():
            break
    told = F.array(*(F.lit(float(v)) for v in np.sort(null)))
    larger = F.size(F.filter(told, lambda m: m >= F.col("r2") - 1e-12))
    return rows.select("v_idx", "r2", ((1 + larger) / (done + 1)).alias("p_fwer"), F.lit(done).alias("n_permutations"))


def power_curve(n: Column, af: Column, beta: Column, alpha: float = 5e-8) -> Column:
    """Power of a two-sided test at effect, frequency and size."""
    root = F.sqrt(2 * n * af * (1 - af) * beta * beta)
    cut = F.lit(float(specfun.norm_ppf(1 - alpha / 2)[0]))
    return specfun.norm_cdf_udf(root - cut) + specfun.norm_cdf_udf(-root - cut)


def empirical_brown(p: np.ndarray, data: np.ndarray) -> float:
    """Fisher's statistic of tests whose dependence is that of ``data`` (tests x samples): the covariance of each test's -2 log empirical tail."""
    k = len(p)
    ranks = data.argsort(axis=1).argsort(axis=1)
    w = -2 * np.log((data.shape[1] - ranks) / (data.shape[1] + 1))
    cov = np.atleast_2d(np.cov(w))
    mean, var = 2.0 * k, 4.0 * k + 2 * float(np.triu(cov, 1).sum())
    scale, df = var / (2 * mean), min(2 * mean * mean / var, 2.0 * k)
    stat = float(-2 * np.log(np.maximum(p, 1e-300)).sum())
    return float(np.clip(specfun.chi2_sf(stat / max(scale, 1.0 if df >= 2 * k else scale), df), specfun.FLOOR, 1))


def stouffer_by_r2(rows: DataFrame, group: str, p: str = "p", r2: str = "r2") -> DataFrame:
    """Stouffer's sum with the roots of prediction R-squared as weights."""
    from .evidence import stouffer

    return stouffer(rows.withColumn("__root", F.sqrt(F.greatest(F.col(r2), F.lit(0.0)))), group, p, "__root")


def conditional_evidence(rows: DataFrame, p_twas: str = "p_twas", p_marginal: str = "p_gwas", p_given: str = "p_conditional", drop: float = 1.0) -> DataFrame:
    """``rows`` with p_combined and mediated: where conditioning on expression costs the variant ``drop`` in -log10 p, the gene's own p; else both by Cauchy."""
    from .combine import cauchy_sf, cauchy_term

    lost = F.log10(F.greatest(F.col(p_given), F.lit(1e-300))) - F.log10(F.greatest(F.col(p_marginal), F.lit(1e-300)))
    both = cauchy_sf((cauchy_term(F.col(p_marginal)) + cauchy_term(F.col(p_twas))) / 2)
    return rows.withColumn("mediated", lost >= drop).withColumn("p_combined", F.when(F.col("mediated"), F.col(p_twas)).otherwise(both))


def gated_evidence(rows: DataFrame, posterior: str = "posterior", least: float = 0.8, p_gwas: str = "p_gwas", p_twas: str = "p_twas") -> DataFrame:
    """``rows`` with p_combined where colocalisation reaches ``least``, null elsewhere."""
    from .combine import cauchy_sf, cauchy_term

    both = cauchy_sf((cauchy_term(F.col(p_gwas)) + cauchy_term(F.col(p_twas))) / 2)
    return rows.withColumn("p_combined", F.when(F.col(posterior) >= least, both))


def bootstrap_winners(rows: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """``rows`` with beta_corrected: the estimate less the mean excess of selected draws, by simulating estimates and rankings (Forde's parametric bootstrap).

    Each draw re-ranks all variants by |z|; the bias at a rank is smoothed over its draws. The
    ranks come from buckets of z, so no task holds the table.
    """
    z = F.col("beta") / F.col("se")
    scored = rows.withColumn("__z", z).withColumn("__k", F.least(F.floor(F.abs("__z") * 20), F.lit(400)).cast("int"))
    noise = F.randn(seed)
    simulated = scored.crossJoin(F.broadcast(rows.sparkSession.range(draws).select(F.col("id").alias("__d"))))  # draws rows
    simulated = simulated.withColumn("__s", F.col("__z") + noise)
    bias = simulated.groupBy(F.least(F.floor(F.abs("__s") * 20), F.lit(400)).cast("int").alias("__b")).agg(F.avg((F.abs("__s") - F.abs("__z")) * F.when(F.signum("__s") == F.signum("__z"), 1.0).otherwise(0.0)).alias("__bias"))
    out = scored.join(F.broadcast(bias), F.col("__k") == F.col("__b"), "left")  # 401 rows
    corrected = F.greatest(F.abs("__z") - F.greatest(F.coalesce("__bias", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * F.signum("__z") * F.col("se")
    return out.withColumn("beta_corrected", corrected).drop("__z", "__k", "__b", "__bias")


def hidden_factors(values: pd.DataFrame, covariates: np.ndarray | None = None, factors: int = 5) -> pd.DataFrame:
    """Expression (samples x genes) without its covariates and leading hidden factors, genes centred again."""
    x = values.to_numpy(float) - values.to_numpy(float).mean(axis=0)
    if covariates is not None:
        c = np.column_stack([np.ones(len(x)), covariates])
        x = x - c @ np.linalg.lstsq(c, x, rcond=None)[0]
    u, s, w = np.linalg.svd(x, full_matrices=False)
    k = min(factors, len(s))
    return pd.DataFrame(x - (u[:, :k] * s[:k]) @ w[:k], index=values.index, columns=values.columns)


def normal_scores(value: str, within: list[str], offset: float = 0.375) -> Column:
    """Inverse normal transform of ranks, ties averaged."""
    from pyspark.sql import Window

    from .encode import average_rank

    n = F.count(value).over(Window.partitionBy(*within))
    return specfun.norm_ppf_udf((average_rank(value, within) - offset) / (n + 1 - 2 * offset))
