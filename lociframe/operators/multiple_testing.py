"""Adjusted p-values. Every function takes a table with a p column and adds the adjusted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running, running_sums, with_rank


def _count(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("m"))))  # one row: the number of tests


def bonferroni(df: DataFrame, p: str = "p", out: str = "p_adj") -> DataFrame:
    return _count(df).withColumn(out, F.least(F.col(p) * F.col("m"), F.lit(1.0))).drop("m")


def sidak(df: DataFrame, p: str = "p", out: str = "p_adj") -> DataFrame:
    return _count(df).withColumn(out, 1 - F.pow(1 - F.col(p), F.col("m"))).drop("m")


def holm(df: DataFrame, ties: list[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Step-down: running maximum of p times the number of tests not yet passed."""
    rows = with_rank(df, p, ties).withColumn("__v", F.least(F.col(p) * (F.col("m") - F.col("i") + 1), F.lit(1.0)))
    return running(rows, "__v", out, ties).drop("__v", "i", "m", "bucket")


def step_up(df: DataFrame, ties: list[str], p: str = "p", out: str = "p_adj", factor: Column | None = None, groups: list[str] | None = None) -> DataFrame:
    """Running minimum, from the largest p, of p * m / rank * factor, at most 1."""
    rows = with_rank(df, p, ties, groups)
    value = F.col(p) * F.col("m") / F.col("i")
    rows = rows.withColumn("__v", F.least(value if factor is None else value * factor, F.lit(1.0)))
    return running(rows, "__v", out, ties, groups, down=True).drop("__v", "i", "m", "bucket")


def benjamini_hochberg(df: DataFrame, ties: list[str], p: str = "p", out: str = "p_adj", groups: list[str] | None = None) -> DataFrame:
    return step_up(df, ties, p, out, groups=groups)


def benjamini_yekutieli(df: DataFrame, ties: list[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg times the harmonic number of the number of tests."""
    m = F.col("m").cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(10_000)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / x)
    far = F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)
    harmonic = df.agg(F.count("*").alias("m")).select(F.when(F.col("m") <= 10_000, exact).otherwise(far).alias("__harmonic"))
    return step_up(df.crossJoin(F.broadcast(harmonic)), ties, p, out, F.col("__harmonic")).drop("__harmonic")


def storey(df: DataFrame, ties: list[str], p: str = "p", out: str = "q", cut: float = 0.5) -> DataFrame:
    """q-values: Benjamini-Hochberg times the estimated share of true nulls, which is 1/m at least and 1 at most."""
    n = F.count("*")
    share = F.least(F.greatest(F.count(F.when(F.col(p) > cut, 1)) / (n * (1 - cut)), 1 / n), F.lit(1.0))
    rows = df.crossJoin(F.broadcast(df.agg(share.alias("__pi0"))))
    return step_up(rows, ties, p, out, F.col("__pi0")).withColumnRenamed("__pi0", "pi0")


def weighted_bh(df: DataFrame, weight: str, ties: list[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg on p over the weight relative to its mean; weight 0 is never significant."""
    rows = df.crossJoin(F.broadcast(df.agg(F.avg(weight).alias("__mean"))))
    scaled = F.when(F.col(weight) > 0, F.least(F.col(p) / (F.col(weight) / F.col("__mean")), F.lit(1e6))).otherwise(1e6)
    return step_up(rows.withColumn("__pw", scaled), ties, "__pw", out).drop("__pw", "__mean")


def hierarchical(df: DataFrame, group: str, ties: list[str], p: str = "p", out: str = "p_adj", q: float = 0.05) -> DataFrame:
    """Two stages: Simes p of each group, Benjamini-Hochberg over groups, then within groups; 1 in groups that fail."""
    ranked = with_rank(df, p, ties, [group])
    simes = ranked.groupBy(group).agg(F.min(F.col(p) * F.col("m") / F.col("i")).alias("__pg"))
    simes = benjamini_hochberg(simes, [group], "__pg", "group_adj")
    rows = benjamini_hochberg(df, ties, p, "__within", [group]).join(simes.select(group, "group_adj"), group)
    return rows.withColumn(out, F.when(F.col("group_adj") <= q, F.greatest("group_adj", "__within")).otherwise(1.0)).drop("__within")


def knockoff_filter(df: DataFrame, w: str, q: float = 0.1) -> DataFrame:
    """Rows selected by the knockoff+ threshold on the statistic ``w``."""
    near = df.select(F.abs(F.col(w)).alias("t"), (F.col(w) > 0).cast("int").alias("up"), (F.col(w) < 0).cast("int").alias("down")).where("t > 0")
    sums = near.groupBy("t").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    sums = running_sums(sums.withColumn("minus", -F.col("t")), "minus", [], {"down": "downs", "up": "ups"})
    threshold = sums.withColumn("fdp", (1 + F.col("downs")) / F.greatest(F.lit(1), F.col("ups"))).where((F.col("fdp") <= q) & (F.col("up") > 0)).agg(F.min("t").alias("threshold"))
    return df.crossJoin(F.broadcast(threshold)).withColumn("selected", F.coalesce(F.col(w) >= F.col("threshold"), F.lit(False)))
