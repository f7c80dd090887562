"""Repeated measures: time bases and per-individual coefficients."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest eigenvalue of an individual's scaled products that are solved as sums; below, its different times are fitted themselves.
LEAST_EIGENVALUE = 1e-8


def standardised_time(time: Column, low: float, high: float) -> Column:
    """Time mapped to [-1, 1]."""
    return 2 * (time - low) / (high - low) - 1 if high > low else time * 0.0


def legendre(t: Column, order: int) -> list[Column]:
    """Normalised Legendre polynomials of orders 0 .. order, by their recurrence."""
    plain = [F.lit(1.0), t]
    for k in range(1, order):
        plain.append(((2 * k + 1) * t * plain[k] - k * plain[k - 1]) / (k + 1))
    return [math.sqrt((2 * k + 1) / 2) * p for k, p in enumerate(plain[: order + 1])]


def bspline(t: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis on a clamped knot vector made of boundary and interior knots."""
    full = np.concatenate([np.repeat(knots[0], degree), knots, np.repeat(knots[-1], degree)])
    basis = ((t[:, None] >= full[:-1]) & (t[:, None] < full[1:])).astype(float)
    last = np.flatnonzero(full[:-1] < full[1:])[-1]
    basis[t == full[-1], last] = 1.0
    for d in range(1, degree + 1):
        n = basis.shape[1] - 1
        left, right = full[d : d + n] - full[:n], full[d + 1 : d + 1 + n] - full[1 : 1 + n]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (t[:, None] - full[:n]) / left, 0.0)
            b = np.where(right > 0, (full[d + 1 : d + 1 + n] - t[:, None]) / right, 0.0)
        basis = a * basis[:, :-1] + b * basis[:, 1:]
    return basis


def difference_penalty(n: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(n), order, axis=0)
    return d.T @ d


def individual_lines(rows: DataFrame, who: str, time: str, value: str) -> DataFrame:
    """Intercept and slope on the normalised Legendre basis of each individual with two times or more, in closed form."""
    bounds = rows.agg(F.min(time).cast("double").alias("low"), F.max(time).cast("double").alias("high"))
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("t", 2 * (F.col(time) - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) - 1)
    m = placed.groupBy(who).agg(F.count("*").alias("n"), F.countDistinct("t").alias("k"), F.regr_slope(F.col(value), F.col("t")).alias("slope"), F.regr_intercept(F.col(value), F.col("t")).alias("intercept"))
    return m.where("k > 1").select(who, "n", (F.col("intercept") * math.sqrt(2)).alias("a0"), (F.col("slope") / math.sqrt(1.5)).alias("a1"))


def individual_coefficients(rows: DataFrame, who: str, time: str, value: str, order: int = 2) -> DataFrame:
    """Least-squares Legendre coefficients of each individual with more times than the order.

    Sums of basis products combine before they are shuffled, so no task holds an individual's measures;
    Python solves a few systems of order + 1 at a time. Only where these are near singular, times being
    few or close together, the individual's different times come together for least squares.
    """
    low, high = rows.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    kind = rows.schema[who].dataType.simpleString()
    k = order + 1
    basis = legendre(standardised_time(F.col(time).cast("double"), low or 0.0, high or 0.0), order)
    placed = rows.select(F.col(who), F.col(value).cast("double").alias("y"), *(b.alias(f"b{i}") for i, b in enumerate(basis)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in pairs] + [F.sum(F.col(f"b{i}") * F.col("y")) for i in range(k)]
    names = [f"s{c}" for c in range(len(sums))]
    totals = placed.groupBy(who).agg(F.count("*").alias("n"), *(s.alias(c) for s, c in zip(sums, names, strict=True))).where(F.col("n") > order)

    def run(stream):
        for batch in stream:
            t = batch[names].to_numpy(float)
            gram = np.zeros((len(t), k, k))
            for c, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = t[:, c]
            scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 1e-300))
            gram = gram / (scale[:, :, None] * scale[:, None])  # of unit diagonal
            known = np.isfinite(t).all(axis=1)
            ok = known.copy()
            ok[known] = np.linalg.eigvalsh(gram[known])[:, 0] > LEAST_EIGENVALUE
            found = np.full((len(t), k), np.nan)
            found[ok] = np.linalg.solve(gram[ok], (t[:, len(pairs) :] / scale)[ok][:, :, None])[:, :, 0] / scale[ok]
            yield pd.DataFrame({who: batch[who], "near": known & ~ok, "coefficients": list(found)})[known]

    solved = totals.mapInPandas(run, f"{who} {kind}, near boolean, coefficients array<double>")
    near = solved.where("near").select(F.col(who).alias("__who"))
    close = placed.join(near, F.col(who).eqNullSafe(F.col("__who")), "left_semi").groupBy(who, *(f"b{i}" for i in range(k))).agg(F.count("y").alias("n"), F.avg("y").alias("y"))
    lists = close.groupBy(who).agg(*(F.collect_list(c).alias(c) for c in ("n", "y", *(f"b{i}" for i in range(k)))))

    def fit(stream):
        for batch in stream:
            out = []
            for r in range(batch.num_rows):
                n, y, *b = (batch.column(c)[r].values.to_numpy().astype(float) for c in ("n", "y", *(f"b{i}" for i in range(k))))
                b, w = np.column_stack(b), np.sqrt(n)
                out.append(np.linalg.lstsq(w[:, None] * b, w * y, rcond=None)[0].tolist() if np.linalg.matrix_rank(b) > order else None)
            yield pa.RecordBatch.from_arrays([batch.column(who), pa.array(out, pa.list_(pa.float64()))], [who, "coefficients"])

    fitted = lists.mapInArrow(fit, f"{who} {kind}, coefficients array<double>").where("coefficients IS NOT NULL")
    return solved.where("NOT near").select(who, "coefficients").unionByName(fitted)
