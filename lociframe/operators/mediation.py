"""Mediation through a molecular feature: second moments of each (variant, feature) pair, or mixed models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from .mixed import NullFit
from .packed import pack


def sobel(rows: DataFrame, keys: list[str], x: str = "x", m: str = "m", y: str = "y") -> DataFrame:
    """Paths a (x to m), b and c' (m and x to y), total c, the indirect effect and Sobel's z.

    One aggregation gives the centred second moments; the regressions follow in closed form.
    """
    n = F.count("*")
    pairs = {"xx": (x, x), "mm": (m, m), "yy": (y, y), "xm": (x, m), "xy": (x, y), "my": (m, y)}
    s = rows.groupBy(*keys).agg(n.alias("n"), *((F.covar_pop(*ab) * n).alias(k) for k, ab in pairs.items())).where("n > 4 AND xx > 1e-9")
    det = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    s = s.withColumn("det", det).where("det > 1e-9")
    s = s.withColumns(
        {
            "a": F.col("xm") / F.col("xx"), "c": F.col("xy") / F.col("xx"), "b": (F.col("xx") * F.col("my") - F.col("xm") * F.col("xy")) / F.col("det"),
            "direct": (F.col("mm") * F.col("xy") - F.col("xm") * F.col("my")) / F.col("det"),
        }
    )
    var_a = (F.col("mm") - F.col("a") * F.col("xm")) / (F.col("n") - 2) / F.col("xx")
    rss = F.col("yy") - F.col("b") * F.col("my") - F.col("direct") * F.col("xy")
    var_b = rss / (F.col("n") - 3) * F.col("xx") / F.col("det")
    s = s.withColumns({"indirect": F.col("a") * F.col("b"), "se": F.sqrt(F.col("a") * F.col("a") * var_b + F.col("b") * F.col("b") * var_a)})
    share = F.when((F.abs("c") > 1e-12) & (F.col("direct") * F.col("indirect") >= 0), F.col("indirect") / F.col("c"))
    return s.select(*keys, "n", "a", "b", "c", "direct", "indirect", "se", (F.col("indirect") / F.col("se")).alias("z"), share.alias("proportion"))


def monte_carlo(a: float, se_a: float, b: float, se_b: float, draws: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """(se, low, high) of the indirect effect by drawing both paths."""
    rng = np.random.default_rng(seed)
    product = rng.normal(a, se_a, draws) * rng.normal(b, se_b, draws)
    return float(product.std(ddof=1)), *(float(v) for v in np.quantile(product, [0.025, 0.975]))


def bootstrap(x: np.ndarray, m: np.ndarray, y: np.ndarray, draws: int = 1000, seed: int = 0) -> tuple[float, float, float]:
    """(se, low, high) of the indirect effect by drawing samples with replacement."""
    rng, n = np.random.default_rng(seed), len(y)
    out = np.empty(draws)
    for k in range(draws):
        at = rng.integers(0, n, n)
        cov = np.cov(np.stack([x[at], m[at], y[at]]))
        det = cov[0, 0] * cov[1, 1] - cov[0, 1] ** 2
        out[k] = cov[0, 1] / cov[0, 0] * (cov[0, 0] * cov[1, 2] - cov[0, 1] * cov[0, 2]) / det if cov[0, 0] > 0 and det > 0 else np.nan
    return float(np.nanstd(out, ddof=1)), *(float(v) for v in np.nanquantile(out, [0.025, 0.975]))


def sensitivity(b: float, sigma_mediator: float, sigma_outcome: float) -> float:
    """The correlation of the two models' errors at which the indirect effect vanishes."""
    return float(np.clip(b * sigma_mediator / sigma_outcome, -1, 1))


def mixed_paths(x: np.ndarray, m: np.ndarray, y: np.ndarray, covariates: np.ndarray, mediator: NullFit, outcome: NullFit) -> dict[str, float]:
    """Paths of one variant and mediator under two mixed null fits of the same samples: weighted least squares with each fit's covariance.

    a from the mediator on the variant, b and c' from the outcome on both, c from the outcome on
    the variant; Sobel's error, and the share mediated where signs allow one.
    """

    def gls(fit: NullFit, design: np.ndarray, response: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        hd = fit.times(design)
        inverse = np.linalg.inv(design.T @ hd)
        beta = inverse @ (hd.T @ response)
        r = response - design @ beta
        s2 = float(r @ fit.times(r)) / (len(response) - design.shape[1])
        return beta, inverse * s2, s2

    first = np.column_stack([x, covariates])
    a, va, sm = gls(mediator, first, m)
    both, vb, sy = gls(outcome, np.column_stack([m, x, covariates]), y)
    total, vc, _ = gls(outcome, first, y)
    indirect = a[0] * both[0]
    se = float(np.sqrt(a[0] ** 2 * vb[0, 0] + both[0] ** 2 * va[0, 0]))
    share = indirect / total[0] if abs(total[0]) > 1e-12 and both[1] * indirect >= 0 else float("nan")
    return {
        "a": float(a[0]), "se_a": float(va[0, 0] ** 0.5), "b": float(both[0]), "se_b": float(vb[0, 0] ** 0.5), "direct": float(both[1]), "total": float(total[0]), "se_total": float(vc[0, 0] ** 0.5),
        "indirect": float(indirect), "se": se, "z": float(indirect / se) if se > 0 else 0.0, "proportion": float(share), "rho": sensitivity(both[0], sm**0.5, sy**0.5),
    }


def scan_mixed(cells: DataFrame, mediators: DataFrame, pairs: DataFrame, y: np.ndarray, covariates: np.ndarray, mediator: NullFit, outcome: NullFit) -> DataFrame:
    """`mixed_paths` of each pair (feature, v_idx): calls and mediators (feature, s_idx, m) are packed by row, one pair is one row.

    The null fits are broadcast; the mediator's variances are shared by all features.
    """
    order = np.array(outcome.samples)
    shared = cells.sparkSession.sparkContext.broadcast((y, covariates, mediator, outcome))
    own = mediators.groupBy("feature").agg(F.collect_list(F.struct("s_idx", "m")).alias("x")).select("feature", F.col("x.s_idx").alias("fs"), F.col("x.m").alias("fm"))
    rows = pairs.join(pack(cells), "v_idx").join(own, "feature")
    names = ["a", "se_a", "b", "se_b", "direct", "total", "se_total", "indirect", "se", "z", "proportion", "rho"]

    def run(stream):
        y, c, first, second = shared.value
        for batch in stream:
            out = []
            for s, d, fs, fm in zip(batch["s"], batch["d"], batch["fs"], batch["fm"], strict=True):
                x, m = np.full(len(order), np.nan), np.full(len(order), np.nan)
                x[np.searchsorted(order, s)], m[np.searchsorted(order, fs)] = d, fm
                x, m = np.where(np.isnan(x), np.nanmean(x), x), np.where(np.isnan(m), np.nanmean(m), m)
                out.append(mixed_paths(x, m, y, c, first, second) if x.std() > 0 and m.std() > 0 else dict.fromkeys(names, float("nan")))
            yield pd.concat([batch[["feature", "v_idx"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.mapInPandas(run, "feature string, v_idx long, " + ", ".join(f"{n} double" for n in names))


def expression_kernel(values: np.ndarray) -> np.ndarray:
    """Similarity of samples in expression (samples x genes), of mean diagonal one."""
    z = (values - values.mean(axis=0)) / np.maximum(values.std(axis=0), 1e-12)
    k = z @ z.T
    return k * len(k) / np.trace(k)


def kernel_shares(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, expression: np.ndarray, samples: list[int]) -> dict[str, float]:
    """Shares of the variance that relationship and expression explain together."""
    from .multitrait import fit_kernels

    fit = fit_kernels(y, x, [kinship, expression_kernel(expression)], samples)
    s = fit.variances / fit.variances.sum()
    return {"genetic": float(s[0]), "expression": float(s[1]), "residual": float(s[2]), "log_likelihood": fit.log_likelihood}


def gene_set(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set: the number of its genes' mediation tests, Stouffer's sum of z over their number's root, and its p; rows: (gene, z), sets: (gene, gene_set)."""
    m = rows.join(sets.select("gene", "gene_set").distinct(), "gene").groupBy("gene_set").agg(F.count("*").alias("n"), (F.sum("z") / F.sqrt(F.count("*"))).alias("z"))
    return m.withColumn("p", 2 * specfun.norm_cdf_udf(-F.abs("z")))


def colocalised_pairs(pairs: DataFrame, posteriors: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs (feature, v_idx) whose feature's posterior of a shared cause (feature, pp4) reaches ``least``."""
    return pairs.join(posteriors.where(F.col("pp4") >= least).select("feature"), "feature", "left_semi")
