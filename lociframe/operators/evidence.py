"""Further analytics on summary statistics that need tails or small dense algebra."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import specfun

from .ld import pair_correlations
from .multiple_testing import benjamini_hochberg
from .sumstats import log_abf


def stouffer(df: DataFrame, group: str, p: str = "p", weight: str | None = None) -> DataFrame:
    """One-sided scores, weighted, and the two-sided tail of their sum."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.withColumn("__z", -specfun.norm_ppf_udf(F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1 - 1e-16)))).withColumn("__w", w)
    sums = rows.groupBy(group).agg((F.sum(F.col("__w") * F.col("__z")) / F.sqrt(F.sum(F.col("__w") * F.col("__w")))).alias("z"))
    return sums.withColumn("p_stouffer", 2 * specfun.norm_cdf_udf(-F.abs("z")))


def meta_sample_size(studies: DataFrame, by: str = "snp") -> DataFrame:
    """Signed scores weighted by the root of the study size; studies: (beta, p, n)."""
    z = -specfun.norm_ppf_udf(F.least(F.greatest(F.col("p") / 2, F.lit(1e-300)), F.lit(0.5))) * F.signum("beta")
    rows = studies.withColumn("__z", z)
    sums = rows.groupBy(by).agg((F.sum(F.sqrt("n") * F.col("__z")) / F.sqrt(F.sum("n"))).alias("z"), F.sum("n").alias("n"))
    return sums.withColumn("p", 2 * specfun.norm_cdf_udf(-F.abs("z")))


def han_eskin(studies: DataFrame, by: str = "snp", rounds: int = 100) -> DataFrame:
    """Random effects under a null without heterogeneity: likelihood ratio and its half-half tail. A group is one variant's studies."""
    lists = studies.groupBy(by).agg(F.collect_list("beta").alias("b"), F.collect_list("se").alias("s"))

    def run(stream):
        for batch in stream:
            stat = []
            for b, s in zip(batch["b"], batch["s"], strict=True):
                b, v = np.asarray(b, float), np.asarray(s, float) ** 2
                mu, tau = 0.0, 0.0
                for _ in range(rounds):
                    w = 1 / (v + tau)
                    mu = (w * b).sum() / w.sum()
                    tau = max(0.0, float((w * w * ((b - mu) ** 2 - v)).sum() / (w * w).sum()))
                w = v + tau
                stat.append(float(np.log(v / w).sum() + (b * b / v).sum() - ((b - mu) ** 2 / w).sum()))
            stat = np.maximum(stat, 0)
            yield pd.DataFrame({by: batch[by], "stat": stat, "p": 0.5 * specfun.chi2_sf(stat, 1.0) + 0.5 * specfun.chi2_sf(stat, 2.0)})

    kind = studies.schema[by].dataType.simpleString()
    return lists.mapInPandas(run, f"{by} {kind}, stat double, p double")


def winners_curse(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """beta after the conditional-likelihood correction of significant effects."""
    cut = F.lit(float(specfun.norm_ppf(1 - alpha / 2)[0]))
    z = F.col("beta") / F.col("se")
    pdf = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    bias = (pdf(cut - z) - pdf(-cut - z)) / (specfun.norm_cdf_udf(z - cut) + specfun.norm_cdf_udf(-z - cut))
    return rows.withColumn("beta_corrected", F.when(F.abs(z) >= cut, F.col("beta") - F.col("se") * bias).otherwise(F.col("beta")))


def fiqt(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Effects shrunk by turning BH-adjusted p-values back into scores."""
    z = F.col("beta") / F.col("se")
    scored = rows.withColumn("__p", 2 * specfun.norm_cdf_udf(-F.abs(z)))
    adjusted = benjamini_hochberg(scored, ties, "__p", "__q")
    back = -specfun.norm_ppf_udf(F.greatest(F.col("__q") / 2, F.lit(1e-300))) * F.signum(z)
    return adjusted.withColumn("z_fiqt", F.when(F.col("__q") >= 1, 0.0).otherwise(back)).drop("__p", "__q")


def hyprcoloc(rows: DataFrame, locus: str, traits: list[str], by: str = "v_idx", p1: float = 1e-4, p2: float = 0.98) -> DataFrame:
    """Best cluster of traits that share a causal variant in each locus; rows: (locus, trait, by, beta, se). At most 12 traits."""
    if len(traits) > 12:
        raise ValueError("subsets of more than 12 traits are too many")
    wide = rows.withColumn("l", log_abf(F.col("beta"), F.col("se"))).groupBy(locus, by).pivot("trait", traits).agg(F.first("l")).dropna()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by)
        l = group[traits].to_numpy()
        found, priors = [], 0.0
        k = len(traits)
        for size in range(2, k + 1):
            for s in itertools.combinations(range(k), size):
                joint = l[:, s].sum(axis=1)
                prior = math.log(p1) + (size - 1) * math.log(p2) + (k - size) * math.log(1 - p2)
                priors += math.exp(prior)
                found.append((prior + joint.max() + math.log(np.exp(joint - joint.max()).sum()), size, s, int(np.argmax(joint))))
        null = math.log(max(1e-300, 1 - priors))
        top = max(null, *(f[0] for f in found))
        total = math.exp(null - top) + sum(math.exp(f[0] - top) for f in found)
        score, _, s, lead = max(found, key=lambda f: (f[0], f[1]))
        return pd.DataFrame({locus: [group[locus].iloc[0]], "cluster": [",".join(traits[t] for t in s)], "posterior": [math.exp(score - top) / total], "candidate": [int(group[by].iloc[lead])]})

    kind = rows.schema[locus].dataType.simpleString()
    return wide.groupBy(locus).applyInPandas(run, f"{locus} {kind}, cluster string, posterior double, candidate long")


def mr_presso(inst: DataFrame, n_draws: int = 500, seed: int = 1, outlier_p: float = 0.05) -> DataFrame:
    """Global pleiotropy test and outliers by simulation; instruments are few and come to the driver."""
    t = inst.orderBy("snp").toPandas()
    bx, by, sx, sy = (t[c].to_numpy(float) for c in ("bx", "by", "sx", "sy"))
    w = 1 / sy**2

    def leave_one_out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        xy, xx = w * x * y, w * x * x
        return (xy.sum(axis=-1, keepdims=True) - xy) / (xx.sum(axis=-1, keepdims=True) - xx)

    loo = leave_one_out(bx, by)
    each = w * (by - loo * bx) ** 2
    rng = np.random.default_rng(seed)
    x, y = rng.normal(bx, sx, (n_draws, len(bx))), rng.normal(loo * bx, sy, (n_draws, len(bx)))
    drawn = w * (y - leave_one_out(x, y) * x) ** 2
    p = np.minimum((drawn >= each).mean(axis=0) * len(bx), 1)
    out = pd.DataFrame({"snp": t["snp"], "rss": each, "p_outlier": p, "outlier": p < outlier_p, "p_global": float((drawn.sum(axis=1) >= each.sum()).mean())})
    return inst.sparkSession.createDataFrame(out)


def gene_set_enrichment(genes: DataFrame, sets: DataFrame, gene: str = "gene", z: str = "z", size: str = "k", name: str = "gene_set") -> DataFrame:
    """Per set: one-sided test of membership on gene scores, adjusted for gene size and its logarithm.

    The covariates are projected out once from whole-table moments; each set then needs sums over
    its members only, so sets cost a join and an aggregation.
    """
    t = genes.select(gene, F.col(z).alias("z"), F.lit(1.0).alias("c0"), F.col(size).cast("double").alias("c1"), F.log(F.col(size) + 1.0).alias("c2"))
    cs = ("c0", "c1", "c2")
    moments = t.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a in cs for b in cs), *(F.sum(F.col(a) * F.col("z")).alias(a + "z") for a in cs)).first()
    gram, cross, n = np.array([[moments[a + b] for b in cs] for a in cs]), np.array([moments[a + "z"] for a in cs]), moments["n"]
    inverse = np.linalg.pinv(gram)
    rank = int(np.linalg.matrix_rank(gram))
    member = sets.select(gene, name).distinct().join(t, gene).groupBy(name).agg(F.count("*").alias("m"), F.sum("z").alias("sz"), *(F.sum(c).alias("s" + c) for c in cs))

    def run(stream):
        for b in stream:
            s = b[["sc0", "sc1", "sc2"]].to_numpy()
            mm = b["m"].to_numpy(float) - np.einsum("ij,jk,ik->i", s, inverse, s)
            mz = b["sz"].to_numpy() - s @ inverse @ cross
            zz = moments["zz"] - cross @ inverse @ cross
            ok = (mm > 1e-9) & (b["m"].to_numpy() < n)
            beta = np.where(ok, mz / np.where(ok, mm, 1), 0.0)
            df = n - rank - 1
            se = np.sqrt(np.maximum(zz - beta * mz, 1e-300) / df / np.where(ok, mm, 1))
            t_stat = beta / se
            tail = specfun.t_sf2(t_stat, float(df)) / 2
            yield pd.DataFrame({name: b[name], "n_genes": b["m"], "beta": beta, "p": np.where(ok, np.where(t_stat > 0, tail, 1 - tail), 1.0)})

    return member.mapInPandas(run, f"{name} string, n_genes long, beta double, p double")


#: The grid of scores on which `local_fdr` estimates their density.
GRID_STEP, GRID_END = 0.01, 10.0


def local_fdr(rows: DataFrame, p: str = "p", cut: float = 0.5) -> DataFrame:
    """Local false discovery rate of z = quantile(1 - p): null share times normal density over the scores' density.

    The density is a Gaussian kernel estimate with Scott's width. Scores are shared out between
    their two neighbours on a grid, so only the grid's weights come to the driver, and the density
    between grid points is interpolated; the grid is fine against the width.
    """
    z = -specfun.norm_ppf_udf(F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1 - 1e-15)))
    scored = rows.withColumn("__z", F.least(F.greatest(z, F.lit(-GRID_END)), F.lit(GRID_END)))
    place = (F.col("__z") + GRID_END) / GRID_STEP
    k = F.least(F.floor(place), F.lit(round(2 * GRID_END / GRID_STEP) - 1)).cast("int")
    spread = scored.select("__z", F.explode(F.array(F.struct(k.alias("k"), (1 - (place - k)).alias("w")), F.struct((k + 1).alias("k"), (place - k).alias("w")))).alias("x"))
    stats = scored.agg(F.count("*").alias("n"), F.stddev_samp("__z").alias("sd"), F.count(F.when(F.col(p) > cut, 1)).alias("high")).first()
    n = stats["n"]
    if n < 10 or not stats["sd"]:
        return rows.withColumn("local_fdr", F.lit(1.0))
    grid = np.arange(round(2 * GRID_END / GRID_STEP) + 1) * GRID_STEP - GRID_END
    weight = np.zeros(len(grid))
    for r in spread.groupBy("x.k").agg(F.sum("x.w").alias("w")).collect():
        weight[r["k"]] = r["w"]
    width = stats["sd"] * n**-0.2
    density = np.exp(-0.5 * (np.subtract.outer(grid, grid) / width) ** 2) @ weight / (n * width * math.sqrt(2 * math.pi))
    pi0 = min(max(stats["high"] / (n * (1 - cut)), 0.01), 1.0)

    @F.pandas_udf("double")
    def rate(z: pd.Series) -> pd.Series:
        at = z.to_numpy(float)
        return pd.Series(np.clip(pi0 * specfun.norm_pdf(at) / np.maximum(np.interp(at, grid, density), 1e-20), 0, 1))

    return scored.withColumn("local_fdr", rate("__z")).drop("__z")


def ihw(rows: DataFrame, covariate: str, ties: list[str], p: str = "p", n_bins: int = 10, n_folds: int = 5) -> DataFrame:
    """Covariate-weighted BH: each fold's bin weights come from the other folds' share of small p-values."""
    edges = rows.approxQuantile(covariate, [k / n_bins for k in range(1, n_bins)], 0.001)
    bin_ = sum((F.when(F.col(covariate) > e, 1).otherwise(0) for e in edges), F.lit(0))
    folded = rows.withColumn("__bin", bin_).withColumn("__fold", F.pmod(F.xxhash64(*ties), F.lit(n_folds)))
    counts = folded.groupBy("__bin", "__fold").agg(F.count("*").alias("n"), F.count(F.when(F.col(p) < 0.1, 1)).alias("k")).collect()
    table = []
    for f in range(n_folds):
        share = {b: max(sum(r["k"] for r in counts if r["__bin"] == b and r["__fold"] != f) / max(1, sum(r["n"] for r in counts if r["__bin"] == b and r["__fold"] != f)), 1e-6) for b in {r["__bin"] for r in counts}}
        mean = sum(share.values()) / len(share)
        table += [(int(b), int(f), s / mean) for b, s in share.items()]
    weights = rows.sparkSession.createDataFrame(table, "__bin int, __fold long, weight double")
    from .multiple_testing import weighted_bh

    return weighted_bh(folded.join(F.broadcast(weights), ["__bin", "__fold"]), "weight", ties, p).drop("__bin", "__fold")


def impute_from_neighbours(cells: DataFrame, window: int = 50) -> DataFrame:
    """Missing calls from the variants up to ``window`` places before and after, weighted by |r|; all calls mean-filled first.

    v_idx is a variant's place. The filled mean itself stays where no neighbour is correlated.
    """
    own = Window.partitionBy("v_idx")
    filled = cells.withColumn("filled", F.coalesce("dosage", F.avg("dosage").over(own)))
    places = cells.select("v_idx").distinct().select("v_idx", F.lit("").alias("chr"), F.col("v_idx").alias("pos"))
    pairs = pair_correlations(filled.select("v_idx", "s_idx", F.col("filled").alias("dosage")), places, window)
    near = pairs.select(F.col("i").alias("v_idx"), F.col("j").alias("other"), F.abs("r").alias("w")).unionByName(pairs.select(F.col("j").alias("v_idx"), F.col("i").alias("other"), F.abs("r").alias("w")))
    missing = cells.where("dosage IS NULL").select("v_idx", "s_idx")
    known = filled.select(F.col("v_idx").alias("other"), "s_idx", "filled")
    guess = missing.join(near, "v_idx").join(known, ["other", "s_idx"]).groupBy("v_idx", "s_idx").agg(F.sum(F.col("w") * F.col("filled")).alias("wd"), F.sum("w").alias("w"))
    guess = guess.select("v_idx", "s_idx", F.when(F.col("w") > 1e-10, F.col("wd") / F.col("w")).alias("guess"))
    return filled.join(guess, ["v_idx", "s_idx"], "left").select("v_idx", "s_idx", F.coalesce("dosage", "guess", "filled").alias("dosage"))
