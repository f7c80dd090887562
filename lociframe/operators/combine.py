"""Combination of p-values within groups, in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chi2_sf_even(stat: Column, pairs: Column) -> Column:
    """Upper tail of chi-square with 2 * pairs degrees of freedom: a finite sum."""
    half = stat / 2
    term = F.aggregate(
        F.sequence(F.lit(1), F.greatest(pairs.cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: F.struct((a["t"] * half / k).alias("t"), F.when(k < pairs, a["s"] + a["t"] * half / k).otherwise(a["s"]).alias("s")),
        lambda a: a["s"],
    )
    return F.exp(-half) * term


def fisher(df: DataFrame, group: str, p: str = "p") -> DataFrame:
    rows = df.groupBy(group).agg((-2 * F.sum(F.log(p))).alias("stat"), F.count("*").alias("k"))
    return rows.withColumn("p_fisher", chi2_sf_even(F.col("stat"), F.col("k")))


def cauchy_term(p: Column) -> Column:
    """tan((0.5 - p) * pi), by its limit where p is tiny."""
    return F.when(p < 1e-15, 1 / (p * math.pi)).otherwise(F.tan((0.5 - p) * math.pi))


def cauchy_sf(t: Column) -> Column:
    return F.when(t > 1e15, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi)


def cauchy(df: DataFrame, group: str, p: str = "p", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.groupBy(group).agg((F.sum(w * cauchy_term(F.col(p))) / F.sum(w)).alias("t"))
    return rows.select(group, cauchy_sf(F.col("t")).alias("p_cauchy"))


def min_p(df: DataFrame, group: str, p: str = "p") -> DataFrame:
    return df.groupBy(group).agg((1 - F.pow(1 - F.min(p), F.count("*"))).alias("p_min"))


def harmonic_mean(df: DataFrame, group: str, p: str = "p") -> DataFrame:
    return df.groupBy(group).agg(F.least(F.count("*") / F.sum(1 / F.col(p)), F.lit(1.0)).alias("p_harmonic"))


def truncated_product(df: DataFrame, group: str, p: str = "p", tau: float = 0.05) -> DataFrame:
    """Zaykin's test: the product of the p-values up to tau, with its exact null distribution."""
    rows = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.when(F.col(p) <= tau, F.log(p))).alias("lw"))

    def one(k: Column) -> Column:
        """Probability of k values up to tau with a product of at most exp(lw)."""
        choose = F.exp(F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda a, j: a + F.log((F.col("n") - k + j) / j)))
        gap = k * math.log(tau) - F.col("lw")
        series = F.aggregate(
            F.sequence(F.lit(0), k.cast("int") - 1), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
            lambda a, j: F.struct((a["t"] * gap / (j + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"],
        )
        tail = F.when(F.col("lw") <= k * math.log(tau), F.exp(F.col("lw")) * series).otherwise(F.pow(F.lit(tau), k))
        return choose * F.pow(F.lit(1 - tau), F.col("n") - k) * tail

    total = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, k: a + one(k))
    return rows.withColumn("p_truncated", F.when(F.col("lw").isNull(), 1.0).otherwise(F.least(total, F.lit(1.0)))).select(group, "n", "p_truncated")
