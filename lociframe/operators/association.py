"""Further scans on a mixed null fit: uncertain dosages, regions left out, joint loci, spike and slab, fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import kinship, mixed, multitrait
from .haplotypes import similarity


def projection_diagonal(fit: mixed.NullFit) -> np.ndarray:
    """Diagonal of P (up to sigma2_e): that of the inverse covariance less what the design takes."""
    hx = fit.times(fit.design)
    return 1 + (fit.vectors**2) @ fit.shrink - np.einsum("ij,jk,ik->i", hx, fit.gram_inverse, hx)


def scan_uncertain(moments: DataFrame, fit: mixed.NullFit) -> DataFrame:
    """(v_idx, beta, se, p, noise_share) from expected dosages and their variances (v_idx, s_idx, expected, variance).

    The score's variance grows by each sample's dosage variance times the diagonal of P;
    noise_share is that part of it.
    """
    order = np.array(sorted(fit.samples))
    shared = moments.sparkSession.sparkContext.broadcast((fit, projection_diagonal(fit)))
    packed = moments.groupBy("v_idx").agg(F.collect_list(F.struct("s_idx", "expected", "variance")).alias("x"))
    packed = packed.select("v_idx", F.col("x.s_idx").alias("s"), F.col("x.expected").alias("d"), F.col("x.variance").alias("e"))
    names = ["beta", "se", "p", "noise_share"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, diagonal = shared.value
        n, c = fit.design.shape
        for batch in stream:
            if not batch.num_rows:
                continue
            g, noise = np.zeros((n, batch.num_rows)), np.zeros((n, batch.num_rows))
            for k in range(batch.num_rows):
                at = np.searchsorted(order, batch.column("s")[k].values.to_numpy())
                d = batch.column("d")[k].values.to_numpy()
                g[:, k], noise[at, k] = d.mean(), batch.column("e")[k].values.to_numpy()
                g[at, k] = d
            u, info = mixed._information(fit, g)
            extra = noise.T @ diagonal
            total = np.maximum(info + extra, 1e-300)
            beta, se = u / total, np.sqrt(fit.sigma2_e / total)
            found = [beta, se, specfun.f_sf((beta / se) ** 2, 1.0, float(n - c - 1)), extra / total]
            yield pa.RecordBatch.from_arrays([batch.column("v_idx"), *(pa.array(v) for v in found)], ["v_idx", *names])

    return packed.mapInArrow(run, "v_idx long, " + ", ".join(f"{n} double" for n in names))


def scan_left_out(cells: DataFrame, y: np.ndarray, x: np.ndarray, samples: list[int], by: str, kind: str = "vanraden", ploidy: int = 2, tile: int = kinship.TILE) -> DataFrame:
    """`mixed.scan` of each region (a column of cells) against the relationship of all others.

    Products are made once, by region, and stay a table; the driver holds their sum and one region's.
    """
    kinship._checked(samples)
    rows = kinship.encoded(cells, kind, ploidy).persist()
    found = kinship.tiles(rows, samples, tile, by).persist()
    norms = {r[by]: r["norm"] for r in kinship._norm(rows, by).collect()}
    n = len(samples)
    whole = sum((kinship._assembled(found.where(F.col(by) == c), n, tile, by)[c] for c in norms), np.zeros((n, n)))
    parts = []
    for c in sorted(norms):
        own = kinship._assembled(found.where(F.col(by) == c), n, tile, by)[c]
        k = (whole - own) / max(sum(norms.values()) - norms[c], 1e-10)
        parts.append(mixed.scan(cells.where(F.col(by) == c).drop(by), mixed.fit_null(y, x, k, sorted(samples))).withColumn(by, F.lit(c)))
    found.unpersist()
    rows.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_loci(y: np.ndarray, x: np.ndarray, g: np.ndarray, fit: mixed.NullFit, names: list, threshold: float | None = 0.05) -> list[dict]:
    """Effects of several loci together by generalised least squares; with a threshold the weakest is dropped until all pass."""
    keep: list[int] = []
    for k in range(g.shape[1]):
        # a locus that those before it and the design already span says nothing of its own
        if np.linalg.matrix_rank(np.column_stack([x, g[:, [*keep, k]]])) == x.shape[1] + len(keep) + 1:
            keep.append(k)
    while keep:
        design = np.column_stack([x, g[:, keep]])
        hd = fit.times(design)
        inverse = np.linalg.inv(design.T @ hd)
        beta = inverse @ (hd.T @ y)
        residual = y - design @ beta
        df = len(y) - design.shape[1]
        se = np.sqrt(np.diag(inverse) * float(residual @ fit.times(residual)) / df)
        p = specfun.f_sf((beta / se) ** 2, 1.0, float(df))[x.shape[1] :]
        worst = int(np.argmax(p))
        if threshold is None or p[worst] <= threshold:
            explained = np.var(g[:, keep], axis=0) * beta[x.shape[1] :] ** 2 / max(np.var(y), 1e-300)
            return [{"name": names[k], "beta": float(b), "se": float(s), "p": float(q), "variance_share": float(v)} for k, b, s, q, v in zip(keep, beta[x.shape[1] :], se[x.shape[1] :], p, explained, strict=True)]
        keep.pop(worst)
    return []


def spike_and_slab(y: np.ndarray, g: np.ndarray, share: float = 0.01, slab: float | None = None, rounds: int = 200, tol: float = 1e-6, learn: bool = True) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(inclusion probabilities, effects, bounds) by variational coordinate ascent on standardised columns; the bound never falls.

    With ``learn`` the share of effects, their variance and the residual variance follow each round.
    """
    n, m = g.shape
    z = (g - g.mean(axis=0)) / np.maximum(g.std(axis=0), 1e-12)
    y = y - y.mean()
    s2 = float(y.var())
    slab = slab or 0.1
    alpha, mu = np.full(m, share), np.zeros(m)
    fitted = np.zeros(n)
    zz = (z * z).sum(axis=0)
    bounds: list[float] = []
    for _ in range(rounds):
        var = s2 / (zz + 1 / slab)
        for j in range(m):
            own = alpha[j] * mu[j]
            left = z[:, j] @ (y - fitted) + zz[j] * own
            mu[j] = var[j] / s2 * left
            log = np.log(share / (1 - share)) + 0.5 * np.log(var[j] / (slab * s2)) + 0.5 * mu[j] ** 2 / var[j]
            alpha[j] = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
            fitted += z[:, j] * (alpha[j] * mu[j] - own)
        spread = (zz * (alpha * (mu**2 + var) - (alpha * mu) ** 2)).sum()
        a = np.clip(alpha, 1e-12, 1 - 1e-12)
        bound = -0.5 * n * np.log(2 * np.pi * s2) - (((y - fitted) ** 2).sum() + spread) / (2 * s2)
        bound += (a * np.log(share / a) + (1 - a) * np.log((1 - share) / (1 - a))).sum() + 0.5 * (a * (1 + np.log(var / (slab * s2)) - (mu**2 + var) / (slab * s2))).sum()
        bounds.append(float(bound))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tol * abs(bounds[-1]):
            break
        if learn:
            share = float(np.clip(alpha.mean(), 1 / (10 * m), 0.5))
            slab = float(np.clip((alpha * (mu**2 + var)).sum() / max(alpha.sum(), 1e-12) / s2, 1e-4, 10.0))
            s2 = float((((y - fitted) ** 2).sum() + spread + (alpha * (mu**2 + var)).sum() / slab) / (n + alpha.sum()))
    return alpha, alpha * mu / np.maximum(g.std(axis=0), 1e-12), bounds


def collapse(d: np.ndarray, names: list[str], fit: mixed.NullFit, alpha: float = 0.05) -> list[dict]:
    """Haplotypes tested from all together down a tree of likeness: a group's p is that of its joint score times all over its number, and no smaller than those above it.

    Only groups whose parents pass are opened, which keeps the family-wise error. The tree joins
    the two most alike groups by their mean likeness.
    """
    from .haplotypes import score_test

    near = similarity(names, 1.0)
    groups = [[k] for k in range(len(names))]
    tree: dict[tuple[int, ...], tuple[tuple[int, ...], ...]] = {}
    while len(groups) > 1:
        pairs = [(near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        joined = sorted(groups[i] + groups[j])
        tree[tuple(joined)] = (tuple(groups[i]), tuple(groups[j]))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    out: list[dict] = []
    waiting = [(tuple(groups[0]), 0.0)] if groups else []
    while waiting:
        group, above = waiting.pop(0)
        _, _, p = score_test(d[:, list(group)], fit)
        adjusted = max(above, min(1.0, p * len(names) / len(group)))
        out.append({"haplotypes": [names[k] for k in group], "p": p, "p_adj": adjusted})
        if adjusted <= alpha:
            waiting += [(child, adjusted) for child in tree.get(group, ())]
    return out


def random_regression_in_field(y: np.ndarray, times: np.ndarray, rows: np.ndarray, columns: np.ndarray, order: int = 1, knots: int = 5) -> np.ndarray:
    """Coefficients of `multitrait.random_regression` after each time's smooth trend over the field is taken out."""
    flat = np.stack([y[:, k] - multitrait.spatial_trend(y[:, k], rows, columns, knots)[0] + y[:, k].mean() for k in range(y.shape[1])], axis=1)
    return multitrait.random_regression(flat, times, order)
