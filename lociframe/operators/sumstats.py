"""Analytics on summary statistics: alignment, meta-analysis, Mendelian randomisation, colocalisation, TWAS."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_sums


def _w() -> Column:
    """Inverse variance."""
    return 1 / (F.col("se") * F.col("se"))


def align(reference: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` on the reference's alleles: beta and af turn where a1 and a2 are swapped; other mismatches stay as they are."""
    ref = reference.select("snp", F.upper("a1").alias("ref_a1"), F.upper("a2").alias("ref_a2"))
    rows = other.join(ref, "snp")
    swapped = (F.upper("a1") == F.col("ref_a2")) & (F.upper("a2") == F.col("ref_a1"))
    rows = rows.withColumn("flipped", swapped).withColumn("beta", F.when(swapped, -F.col("beta")).otherwise(F.col("beta")))
    if "af" in other.columns:
        rows = rows.withColumn("af", F.when(swapped, 1 - F.col("af")).otherwise(F.col("af")))
    return rows.withColumns({"a1": F.when(swapped, F.col("ref_a1")).otherwise(F.col("a1")), "a2": F.when(swapped, F.col("ref_a2")).otherwise(F.col("a2"))}).drop("ref_a1", "ref_a2")


def harmonize(target: DataFrame, source: DataFrame, af_tolerance: float = 0.08) -> DataFrame:
    """Match by snp and alleles: direct, swapped, or on the other strand; palindromes near frequency 0.5 are ambiguous."""
    ref = target.select("snp", F.upper("a1").alias("t1"), F.upper("a2").alias("t2"))
    other = lambda c: F.translate(F.upper(c), "ACGT", "TGCA")
    rows = source.join(ref, "snp")
    direct, swapped = (F.upper("a1") == F.col("t1")) & (F.upper("a2") == F.col("t2")), (F.upper("a1") == F.col("t2")) & (F.upper("a2") == F.col("t1"))
    flipped, both = (other("a1") == F.col("t1")) & (other("a2") == F.col("t2")), (other("a1") == F.col("t2")) & (other("a2") == F.col("t1"))
    palindrome = other("a1") == F.upper("a2")
    status = F.when(palindrome & (F.abs(F.col("af") - 0.5) < af_tolerance), "ambiguous").when(direct, "direct").when(swapped, "swapped").when(flipped, "flipped").when(both, "flipped_swapped").otherwise("mismatch")
    sign = F.when(F.col("status").isin("swapped", "flipped_swapped"), -1).otherwise(1)
    return rows.withColumn("status", status).withColumn("sign", sign).drop("t1", "t2")


def meta_fixed(studies: DataFrame, by: str = "snp") -> DataFrame:
    """Inverse-variance weighted mean with Cochran's Q and I2, in one aggregation."""
    m = studies.groupBy(by).agg(F.count("*").alias("k"), F.sum(_w()).alias("w"), F.sum(_w() * _w()).alias("w2"), F.sum(_w() * F.col("beta")).alias("wb"), F.sum(_w() * F.col("beta") * F.col("beta")).alias("wbb"))
    q = F.greatest(F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w"), F.lit(0.0))
    m = m.withColumn("q", q)
    i2 = F.when(F.col("q") > 0, F.greatest((F.col("q") - (F.col("k") - 1)) / F.col("q"), F.lit(0.0))).otherwise(0.0)
    tau2 = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w")))).otherwise(0.0)
    return m.select(by, "k", (F.col("wb") / F.col("w")).alias("beta"), F.sqrt(1 / F.col("w")).alias("se"), "q", i2.alias("i2"), tau2.alias("tau2"))


def meta_random(studies: DataFrame, by: str = "snp") -> DataFrame:
    """DerSimonian-Laird: the fixed-effect pass gives tau2, a second one the weights."""
    rows = studies.join(meta_fixed(studies, by).select(by, "tau2"), by)
    w = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
    return rows.groupBy(by).agg((F.sum(w * F.col("beta")) / F.sum(w)).alias("beta"), F.sqrt(1 / F.sum(w)).alias("se"), F.max("tau2").alias("tau2"))


def log_sum_exp(*terms: Column) -> Column:
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def mantra(studies: DataFrame, by: str = "snp", s2: float = 0.04, prior: float = 0.5) -> DataFrame:
    """Log Bayes factors of one shared effect and of separate ones, and their mixture."""
    single = 1 / (1 / s2 + _w())
    m = studies.groupBy(by).agg(
        F.sum(_w()).alias("w"), F.sum(_w() * F.col("beta")).alias("wb"), F.sum(0.5 * F.log(single / s2) + 0.5 * F.pow(single * _w() * F.col("beta"), 2) / single).alias("log_bf_separate")
    )
    v = 1 / (1 / s2 + F.col("w"))
    shared = 0.5 * F.log(v / s2) + 0.5 * F.pow(v * F.col("wb"), 2) / v
    m = m.withColumn("log_bf_shared", shared)
    return m.select(by, "log_bf_shared", "log_bf_separate", log_sum_exp(F.col("log_bf_shared") + math.log(prior), F.col("log_bf_separate") + math.log(1 - prior)).alias("log_bf"))


def instruments(exposure: DataFrame, outcome: DataFrame, by: str = "snp") -> DataFrame:
    """(snp, bx, sx, by, sy) of variants in both tables."""
    x = exposure.select(by, F.col("beta").alias("bx"), F.col("se").alias("sx"))
    return x.join(outcome.select(by, F.col("beta").alias("by"), F.col("se").alias("sy")), by)


def mr_ivw(inst: DataFrame) -> DataFrame:
    """Inverse-variance weighted estimate; its standard error widens with Q beyond its expectation."""
    w = 1 / (F.col("sy") * F.col("sy"))
    m = inst.agg(F.count("*").alias("k"), F.sum(w * F.col("bx") * F.col("by")).alias("xy"), F.sum(w * F.col("bx") * F.col("bx")).alias("xx"), F.sum(w * F.col("by") * F.col("by")).alias("yy"))
    q = F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")
    return m.select("k", (F.col("xy") / F.col("xx")).alias("beta"), (F.sqrt(1 / F.col("xx")) * F.sqrt(F.greatest(F.lit(1.0), q / (F.col("k") - 1)))).alias("se"), q.alias("q"))


def mr_egger(inst: DataFrame) -> DataFrame:
    """Weighted regression with intercept after orienting instruments to a positive exposure effect."""
    x, y, w = F.abs("bx"), F.col("by") * F.signum("bx"), 1 / (F.col("sy") * F.col("sy"))
    m = inst.agg(
        F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy")
    )
    det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    m = m.withColumns({"slope": (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / det, "intercept": (F.col("xx") * F.col("y") - F.col("x") * F.col("xy")) / det, "det": det})
    rss = F.col("yy") - F.col("slope") * F.col("xy") - F.col("intercept") * F.col("y")
    sigma2 = F.greatest(rss / (F.col("k") - 2), F.lit(1.0))
    return m.select("k", "slope", "intercept", F.sqrt(sigma2 * F.col("w") / F.col("det")).alias("se_slope"), F.sqrt(sigma2 * F.col("xx") / F.col("det")).alias("se_intercept"))


def mr_weighted_median(inst: DataFrame, by: str = "snp") -> DataFrame:
    """Median of the ratio estimates by inverse-variance weight, interpolated at one half."""
    rows = inst.where("bx <> 0").select(by, (F.col("by") / F.col("bx")).alias("ratio"), (F.col("bx") * F.col("bx") / (F.col("sy") * F.col("sy"))).alias("w"))
    rows = running_sums(rows, "ratio", [by], {"w": "upto"}).crossJoin(F.broadcast(rows.agg(F.sum("w").alias("total"))))  # one row: the total
    rows = rows.withColumn("at", (F.col("upto") - F.col("w") / 2) / F.col("total"))
    below, place = F.col("at") < 0.5, F.struct("ratio", by, "at")
    ends = rows.agg(F.max(F.when(below, place)).alias("a"), F.min(F.when(~below, place)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return ends.select((F.col("a.ratio") + (F.col("b.ratio") - F.col("a.ratio")) * (0.5 - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))).alias("beta"))


def log_abf(beta: Column, se: Column, prior_w: float = 0.15) -> Column:
    """Wakefield's approximate log Bayes factor."""
    shrink = prior_w * prior_w / (prior_w * prior_w + se * se)
    return 0.5 * F.log(1 - shrink) + 0.5 * shrink * F.pow(beta / se, 2)


def coloc(inst: DataFrame, group: list[str], p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5) -> DataFrame:
    """Posterior of the five colocalisation hypotheses of each group of variants."""
    rows = inst.withColumns({"l1": log_abf(F.col("bx"), F.col("sx")), "l2": log_abf(F.col("by"), F.col("sy"))}).withColumn("l12", F.col("l1") + F.col("l2"))
    own = Window.partitionBy(*group)
    rows = rows.withColumns({f"m{k}": F.max(f"l{k}").over(own) for k in (1, 2, 12)})
    s = rows.groupBy(*group).agg(F.count("*").alias("n"), *((F.max(f"m{k}") + F.log(F.sum(F.exp(F.col(f"l{k}") - F.col(f"m{k}"))))).alias(f"s{k}") for k in (1, 2, 12)))
    gap = F.col("s12") - F.col("s1") - F.col("s2")
    apart = F.when(gap < 0, F.col("s1") + F.col("s2") + F.log(F.greatest(1 - F.exp(gap), F.lit(1e-300)))).otherwise(-700.0)
    terms = [F.lit(0.0), F.col("s1") + math.log(p1), F.col("s2") + math.log(p2), apart + math.log(p1) + math.log(p2), F.col("s12") + math.log(p12)]
    s = s.withColumns({f"t{k}": t for k, t in enumerate(terms)}).withColumn("total", log_sum_exp(*(F.col(f"t{k}") for k in range(5))))
    return s.select(*group, "n", *(F.exp(F.col(f"t{k}") - F.col("total")).alias(f"pp{k}") for k in range(5)))


def smr(inst: DataFrame, gene: str = "gene", by: str = "snp") -> DataFrame:
    """Per gene, at its strongest eQTL: effect and chi-square of the transcript on the trait (x: eQTL, y: trait)."""
    best = Window.partitionBy(gene).orderBy(F.abs(F.col("bx") / F.col("sx")).desc(), by)
    top = inst.withColumn("place", F.row_number().over(best)).where("place = 1")
    zx, zy = F.pow(F.col("bx") / F.col("sx"), 2), F.pow(F.col("by") / F.col("sy"), 2)
    return top.select(gene, by, (F.col("by") / F.col("bx")).alias("beta_smr"), (zx * zy / (zx + zy)).alias("chi2"))


def heidi(inst: DataFrame, gene: str = "gene", by: str = "snp", most: int = 20) -> DataFrame:
    """Sum over the strongest other eQTLs of the squared difference of their ratio from the probe's, over its variance."""
    best = Window.partitionBy(gene).orderBy(F.abs(F.col("bx") / F.col("sx")).desc(), by)
    ratio = F.col("by") / F.col("bx")
    variance = F.pow(F.col("sy") / F.col("bx"), 2) + F.pow(F.col("by") * F.col("sx") / (F.col("bx") * F.col("bx")), 2)
    rows = inst.where("bx <> 0").withColumns({"place": F.row_number().over(best), "ratio": ratio, "var": variance}).where(F.col("place") <= most + 1)
    probe = rows.where("place = 1").select(gene, F.col("ratio").alias("r0"), F.col("var").alias("v0"))
    rows = rows.where("place > 1").join(probe, gene)
    return rows.groupBy(gene).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("ratio") - F.col("r0"), 2) / (F.col("var") + F.col("v0"))).alias("heidi"))


def twas(weights: DataFrame, gwas: DataFrame, gene: str = "gene", by: str = "v_idx") -> DataFrame:
    """Gene z-scores from expression weights and trait z-scores, under independent variants."""
    rows = weights.join(gwas.select(by, (F.col("beta") / F.col("se")).alias("z")), by)
    return rows.groupBy(gene).agg(F.count("*").alias("n_snps"), (F.sum(F.col("weight") * F.col("z")) / F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("z"))


def multi_tissue(stacked: DataFrame, gene: str = "gene") -> DataFrame:
    """Per gene over tissues: extremes, spread, the sum of squared z and the driving tissue."""
    z = F.col("z")
    return stacked.groupBy(gene).agg(
        F.count("*").alias("n_tissues"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_sd"), F.sum(z * z).alias("chi2"),
        F.max_by("tissue", F.struct(F.abs(z), "tissue")).alias("driver"),
    )


def power_ncp(sumstats: DataFrame) -> DataFrame:
    """Non-centrality 2 n p q b^2 of each variant."""
    return sumstats.withColumn("ncp", 2 * F.col("n") * F.col("af") * (1 - F.col("af")) * F.col("beta") * F.col("beta"))


def credible_set(rows: DataFrame, group: list[str], pip: str = "pip", by: str = "v_idx", coverage: float = 0.95) -> DataFrame:
    """The fewest variants of each group, by falling probability, whose sum reaches the coverage."""
    order = Window.partitionBy(*group).orderBy(F.col(pip).desc(), by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(pip).over(order)).where(F.col("upto") - F.col(pip) < coverage)


def posterior(rows: DataFrame, group: list[str]) -> DataFrame:
    """Single-signal inclusion probabilities of each group from approximate Bayes factors."""
    own = Window.partitionBy(*group)
    scaled = rows.withColumn("l", log_abf(F.col("beta"), F.col("se")))
    scaled = scaled.withColumn("e", F.exp(F.col("l") - F.max("l").over(own)))
    return scaled.withColumn("pip", F.col("e") / F.sum("e").over(own)).drop("l", "e")


def polarity_classes(loadings: DataFrame, threshold: float, env: str = "env", factor: str = "factor") -> DataFrame:
    """Environments of equal polarity (P, N or Z for each factor): (class, n, members)."""
    letter = F.when(F.abs("loading") < threshold, "Z").when(F.col("loading") > 0, "P").otherwise("N")
    keys = loadings.groupBy(env).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(factor, letter.alias("letter")))), lambda x: x["letter"]), "").alias("class"))
    return keys.groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(env).cast("string"))), ",").alias("members"))


def ldsc_moments(rows: DataFrame, m_total: float) -> DataFrame:
    """First-step LD score regression: slope and intercept of chi2 on n * l / mean n, and h2."""
    nbar = F.avg("n").over(Window.partitionBy())
    x = F.col("ld_score") * F.col("n") / F.col("nbar")
    m = rows.withColumn("nbar", nbar).agg(F.regr_slope(F.col("chi2"), x).alias("slope"), F.regr_intercept(F.col("chi2"), x).alias("intercept"), F.max("nbar").alias("nbar"), F.avg("chi2").alias("mean_chi2"))
    return m.select("slope", "intercept", "mean_chi2", (F.col("slope") * m_total / F.col("nbar")).alias("h2"))
