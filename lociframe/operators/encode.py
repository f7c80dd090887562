"""Encodings and imputation of long calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _own() -> WindowSpec:
    return Window.partitionBy("v_idx")


def dense(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (variant, sample) cell, null where there is no call; the grid is the genotype matrix itself."""
    grid = variants.select("v_idx").crossJoin(samples.select("s_idx"))
    return grid.join(calls.select("v_idx", "s_idx", "dosage"), ["v_idx", "s_idx"], "left")


def impute_mean(cells: DataFrame) -> DataFrame:
    return cells.withColumn("dosage", F.coalesce("dosage", F.avg("dosage").over(_own())))


def impute_mode(cells: DataFrame) -> DataFrame:
    """Missing calls get the variant's most frequent rounded dosage (the smallest of equals, 0 without calls)."""
    counts = cells.where(F.col("dosage").isNotNull()).groupBy("v_idx", F.round("dosage").alias("d")).count()
    modes = counts.groupBy("v_idx").agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("mode"))
    return cells.join(modes, "v_idx", "left").withColumn("dosage", F.coalesce("dosage", "mode", F.lit(0.0))).drop("mode")


def center(cells: DataFrame) -> DataFrame:
    return cells.withColumn("g", F.col("dosage") - F.avg("dosage").over(_own()))


def scale(cells: DataFrame, ploidy: int = 2) -> DataFrame:
    """Centred and divided by the standard deviation expected under Hardy-Weinberg."""
    af = F.avg("dosage").over(_own()) / ploidy
    return cells.withColumn("g", (F.col("dosage") - F.avg("dosage").over(_own())) / F.sqrt(F.greatest(ploidy * af * (1 - af), F.lit(1e-10))))


def gene_action(dosage: Column, model: str, ploidy: int = 2) -> Column:
    """Recode a dosage; missing stays missing. Models: additive, 1-dom .. k-dom, diplo-additive, overdominant, general."""
    if model == "additive":
        return dosage
    if model.endswith("-dom"):
        least = int(model.removesuffix("-dom"))
        return F.when(dosage.isNotNull(), (dosage >= least).cast("double"))
    if model == "diplo-additive":
        return F.when(dosage.isNull(), None).when(dosage <= 0, 0.0).when(dosage >= ploidy, 2.0).otherwise(1.0)
    if model == "overdominant":
        return F.when(dosage.isNotNull(), ((dosage > 0) & (dosage < ploidy)).cast("double"))
    if model == "general":
        return F.when(dosage.isNotNull(), F.array(*((F.round(dosage) == v).cast("double") for v in range(1, ploidy + 1))))
    raise ValueError(f"unknown gene action {model}")


def gene_action_models(ploidy: int = 2) -> list[str]:
    return ["additive", *(f"{j}-dom" for j in range(1, ploidy + 1)), "diplo-additive", "overdominant", "general"]


def detect_ploidy(calls: DataFrame) -> DataFrame:
    most = F.max(F.round("dosage"))
    return calls.agg(F.when(most <= 2, 2).when(most <= 4, 4).when(most <= 6, 6).when(most <= 8, 8).otherwise(most).cast("int").alias("ploidy"))


def dosage_moments(probs: DataFrame) -> DataFrame:
    """Expected dosage and its variance from (v_idx, s_idx, class, prob)."""
    mean, square = F.sum(F.col("prob") * F.col("class")), F.sum(F.col("prob") * F.col("class") * F.col("class"))
    return probs.groupBy("v_idx", "s_idx").agg(mean.alias("expected"), (square - mean * mean).alias("variance"))


def dosage_rsq(moments: DataFrame, ploidy: int = 2) -> DataFrame:
    """Imputation R-squared of each variant from `dosage_moments`, within [0, 1]."""
    rows = moments.groupBy("v_idx").agg(F.avg("variance").alias("noise"), (F.avg("expected") / ploidy).alias("af"))
    rsq = 1 - F.col("noise") / F.greatest(ploidy * F.col("af") * (1 - F.col("af")), F.lit(1e-10))
    return rows.select("v_idx", F.least(F.greatest(rsq, F.lit(0.0)), F.lit(1.0)).alias("rsq"))


def quantile_normalize(values: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Columns mapped to the mean sorted profile over all columns; tied values get the mean of their places."""
    place = F.row_number().over(Window.partitionBy(column).orderBy(value, row))
    ranked = values.withColumn("place", place)
    profile = ranked.groupBy("place").agg(F.avg(value).alias("level"))
    ties = Window.partitionBy(column, value)
    return ranked.join(profile, "place").withColumn("normalized", F.avg("level").over(ties)).drop("place", "level")


def average_rank(value: Column | str, within: list[str]) -> Column:
    """Rank with ties averaged."""
    order = Window.partitionBy(*within).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2
