"""Single-marker association from sufficient statistics: one aggregation over the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear(calls: DataFrame, y: str = "y") -> DataFrame:
    """Per variant: n, beta, se and t of y on dosage with an intercept; calls carry y."""
    d = F.col("dosage")
    rows = calls.where(d.isNotNull() & F.col(y).isNotNull()).groupBy("v_idx").agg(
        F.count("*").alias("n"), F.regr_slope(F.col(y), d).alias("beta"), F.regr_sxx(F.col(y), d).alias("sxx"), F.regr_syy(F.col(y), d).alias("syy"), F.regr_sxy(F.col(y), d).alias("sxy")
    )
    rows = rows.where((F.col("sxx") > 0) & (F.col("n") > 2))
    se = F.sqrt((F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return rows.select("v_idx", "n", "beta", se.alias("se"), (F.col("beta") / se).alias("stat"))


def linear_with_covariate(calls: DataFrame, y: str = "y", cov: str = "cov") -> DataFrame:
    """Per variant: beta and se adjusted for one covariate, by the Frisch-Waugh theorem on second moments."""
    rows = calls.where(F.col("dosage").isNotNull() & F.col(y).isNotNull() & F.col(cov).isNotNull())
    names = {"g": "dosage", "y": y, "c": cov}
    pairs = ["gg", "yy", "cc", "gy", "gc", "yc"]
    moments = [F.count("*").alias("n")] + [(F.covar_pop(names[a], names[b]) * F.count("*")).alias(a + b) for a, b in pairs]
    m = rows.groupBy("v_idx").agg(*moments).where("n > 3 AND cc > 0")
    gg, gy, yy = (F.col("gg") - F.col("gc") * F.col("gc") / F.col("cc"), F.col("gy") - F.col("gc") * F.col("yc") / F.col("cc"), F.col("yy") - F.col("yc") * F.col("yc") / F.col("cc"))
    m = m.withColumns({"a": gg, "b": gy, "s": yy}).where("a > 1e-9")
    beta = F.col("b") / F.col("a")
    se = F.sqrt((F.col("s") - beta * F.col("b")) / (F.col("n") - 3) / F.col("a"))
    return m.select("v_idx", "n", beta.alias("beta"), se.alias("se"), (beta / se).alias("stat"))


def logistic_score(calls: DataFrame, status: str = "status") -> DataFrame:
    """Per variant: score U, variance V and chi-square for a 0/1 trait under the intercept-only null."""
    rows = calls.where(F.col("dosage").isNotNull() & F.col(status).isNotNull())
    m = rows.groupBy("v_idx").agg(
        F.count("*").alias("n"), F.sum(F.col("dosage") * F.col(status)).alias("gy"), F.sum("dosage").alias("g"), F.avg(F.col(status).cast("double")).alias("mu"),
        (F.var_pop("dosage") * F.count("*")).alias("sxx"),
    )
    u, v = F.col("gy") - F.col("mu") * F.col("g"), F.col("mu") * (1 - F.col("mu")) * F.col("sxx")
    return m.withColumns({"u": u, "v": v}).where("v > 1e-9").select("v_idx", "n", "u", "v", (F.col("u") * F.col("u") / F.col("v")).alias("chi2"))


def within_family(calls: DataFrame, family: str = "family", y: str = "y") -> DataFrame:
    """Slope of y on dosage after both are centred within (variant, family)."""
    own = Window.partitionBy("v_idx", family)
    rows = calls.where(F.col("dosage").isNotNull() & F.col(y).isNotNull())
    rows = rows.select("v_idx", (F.col("dosage") - F.avg("dosage").over(own)).alias("g"), (F.col(y) - F.avg(y).over(own)).alias("r"))
    m = rows.groupBy("v_idx").agg(F.count("*").alias("n"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("g") * F.col("r")).alias("gr")).where("gg > 1e-9")
    return m.select("v_idx", "n", (F.col("gr") / F.col("gg")).alias("beta_within"))


def top_hits(scan: DataFrame, k: int, p: str = "p", ties: str = "v_idx") -> DataFrame:
    return scan.orderBy(p, ties).limit(k)


def top_per_bin(scan: DataFrame, bin_size: int, k: int, p: str = "p") -> DataFrame:
    """Best variant of each (chr, position bin), then the k best of these."""
    own = Window.partitionBy("chr", F.floor(F.col("pos") / bin_size)).orderBy(p, "v_idx")
    return scan.withColumn("place", F.row_number().over(own)).where("place = 1").drop("place").orderBy(p, "v_idx").limit(k)


def variance_explained(scan: DataFrame, frequencies: DataFrame, variance_y: DataFrame, ploidy: int = 2) -> DataFrame:
    """Marginal share of variance of each marker; the shares are scaled down if they sum above 1."""
    rows = scan.join(frequencies, "v_idx").crossJoin(F.broadcast(variance_y))
    rows = rows.withColumn("pve", ploidy * F.col("af") * (1 - F.col("af")) * F.col("beta") * F.col("beta") / F.col("var_y"))
    total = rows.agg(F.sum("pve").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("v_idx", (F.col("pve") / F.greatest(F.col("total"), F.lit(1.0))).alias("pve"))


def best_model(scans: DataFrame, n_samples: int, model: str = "model", params: str = "k", p: str = "p") -> DataFrame:
    """Per variant the gene action of highest -log10 p less 0.5 * (k - 1) * log10(n)."""
    score = -F.log10(F.greatest(F.col(p), F.lit(1e-300))) - 0.5 * (F.col(params) - 1) * F.log10(F.lit(float(n_samples)))
    place = F.row_number().over(Window.partitionBy("v_idx").orderBy(score.desc(), model))
    return scans.withColumn("score", score).withColumn("place", place).where("place = 1").drop("place")
