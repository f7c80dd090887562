"""Per-variant quality control on long calls (v_idx, s_idx, dosage); a null dosage is a missing call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allele_frequency(calls: DataFrame, ploidy: int = 2) -> DataFrame:
    """af = mean dosage / ploidy over observed calls; null where none is observed."""
    return calls.groupBy("v_idx").agg((F.avg("dosage") / ploidy).alias("af"))


def folded(af: Column) -> Column:
    return F.least(af, 1 - af)


def _hwe(ploidy: int, n: Column, p: Column) -> Column:
    """Goodness of fit of the genotype classes to the binomial; expected counts are 0.5 at least."""
    import math

    total = F.lit(0.0)
    for v in range(ploidy + 1):
        expected = n * math.comb(ploidy, v) * F.pow(p, F.lit(v)) * F.pow(1 - p, F.lit(ploidy - v))
        total = total + F.pow(F.col(f"c{v}") - expected, 2) / F.greatest(expected, F.lit(0.5))
    return total


def variant_stats(calls: DataFrame, n_samples: int | DataFrame, ploidy: int = 2) -> DataFrame:
    """One row per variant: counts, missingness, frequencies, heterozygosity, HWE statistic.

    ``n_samples`` is the number of samples, or a sample table to count.
    """
    seen = F.col("dosage").isNotNull()
    classes = [F.count(F.when(F.round("dosage") == v, 1)).alias(f"c{v}") for v in range(ploidy + 1)]
    het = (F.col("dosage") > 0) & (F.col("dosage") < ploidy)
    rows = calls.groupBy("v_idx").agg(
        F.count(F.when(seen, 1)).alias("n_obs"), (F.avg("dosage") / ploidy).alias("af"), F.var_pop("dosage").alias("variance"),
        F.avg(F.when(seen, het.cast("double"))).alias("het"), *classes,
    )
    if isinstance(n_samples, DataFrame):
        rows = rows.crossJoin(F.broadcast(n_samples.agg(F.count("*").alias("n_all"))))
    else:
        rows = rows.withColumn("n_all", F.lit(n_samples).cast("long"))
    p, q = F.col("af"), 1 - F.col("af")
    expected = 2 * p * q if ploidy == 2 else 1 - F.pow(p, F.lit(ploidy)) - F.pow(q, F.lit(ploidy))
    rows = rows.withColumns(
        {
            "n_miss": F.col("n_all") - F.col("n_obs"), "miss_rate": 1 - F.col("n_obs") / F.col("n_all"), "maf": folded(p), "mac": ploidy * F.col("n_obs") * folded(p),
            "mono": (folded(p) == 0) | (F.col("variance") < 1e-10), "het_exp": expected,
        }
    )
    excess = F.when(F.col("het_exp") > 1e-10, (F.col("het") - F.col("het_exp")) / F.col("het_exp")).otherwise(0.0)
    most = F.greatest(*(F.col(f"c{v}") for v in range(ploidy + 1))) / F.col("n_obs")
    return rows.withColumns({"het_excess": excess, "hwe_chi2": _hwe(ploidy, F.col("n_obs"), p), "max_geno_freq": most})


@dataclass(frozen=True)
class Limits:
    """Filters in the order in which the first failure names the reason."""

    max_miss: float = 0.1
    min_maf: float = 0.01
    min_mac: float = 5.0
    max_geno_freq: float = 1.0
    max_hwe_chi2: float = 24.0
    max_het_excess: float = 1.0


def fail_reason(limits: Limits = Limits()) -> Column:
    """Name of the first filter that a row of `variant_stats` fails, null where it passes."""
    return (
        F.when(F.col("mono"), "MONO")
        .when(F.col("miss_rate") > limits.max_miss, "MISS")
        .when(F.col("maf") < limits.min_maf, "MAF")
        .when(F.col("mac") < limits.min_mac, "MAC")
        .when(F.col("max_geno_freq") > limits.max_geno_freq, "GENO_FREQ")
        .when((F.col("n_obs") >= 10) & (F.col("hwe_chi2") > limits.max_hwe_chi2), "HWE")
        .when(F.col("het_excess") > limits.max_het_excess, "HET_EXCESS")
    )


def class_frequencies(calls: DataFrame) -> DataFrame:
    """(v_idx, class, n, share) of rounded dosages."""
    rows = calls.where(F.col("dosage").isNotNull()).groupBy("v_idx", F.round("dosage").cast("int").alias("class")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("v_idx")))


def alignment_manifest(genotyped: DataFrame, phenotyped: DataFrame, key: str) -> DataFrame:
    """Full outer join of two id sets with the reason why an id drops out."""
    both = genotyped.select(key).distinct().withColumn("in_genotype", F.lit(True)).join(phenotyped.select(key).distinct().withColumn("in_phenotype", F.lit(True)), key, "full_outer")
    both = both.na.fill(False, ["in_genotype", "in_phenotype"])
    reason = F.when(~F.col("in_phenotype"), "no_phenotype").when(~F.col("in_genotype"), "no_genotype")
    return both.withColumn("included", F.col("in_genotype") & F.col("in_phenotype")).withColumn("drop_reason", reason)
