"""Facade: files in, one result table out.

    result = gwas(spark, "geno.vcf", "pheno.tsv", trait="Y1", model="lmm")
    result.table.show()
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import specfun
from lociframe.operators import encode, glm, glmm, kinship, mixed, multilocus, multiple_testing, qc, scan
from lociframe.operators.packed import map_variants
from lociframe.sources import readers

#: Model: (traits it is for, what it is).
REGISTRY = {
    "glm": ("continuous", "least squares"), "lmm": ("continuous", "mixed model, one null fit"), "lmm_loco": ("continuous", "mixed model, the tested chromosome left out of the relationship"),
    "lmm_refit": ("continuous", "mixed model, variances fitted for each variant"), "blink": ("continuous", "rounds of scan, pruning and choice by BIC"), "farmcpu": ("continuous", "rounds of scan with the best of each bin"),
    "logistic": ("binary", "logistic score test with saddlepoint tails"), "firth": ("binary", "logistic score test, penalised null fit"), "glmm": ("binary", "logistic mixed model"),
    "probit_glmm": ("binary", "probit mixed model"), "ordinal": ("categorical", "cumulative logits"), "ordinal_glmm": ("categorical", "cumulative logits mixed model"),
    "multinomial": ("categorical", "baseline-category logits"), "multinomial_glmm": ("categorical", "baseline-category logits mixed model"), "poisson_glmm": ("count", "log-linear mixed model"),
    "cox": ("survival", "proportional hazards"), "frailty": ("survival", "proportional hazards with a frailty of relatives"),
}
MODELS = ("auto", *REGISTRY)
CORRECTIONS = ("bh", "by", "holm", "bonferroni")


@dataclass(frozen=True)
class Result:
    """table: chr, pos, snp, a1, a2, af, statistics, p, p_adj. manifest: which samples took part."""

    table: DataFrame
    manifest: DataFrame
    model: str
    n_samples: int


def trait_type(values: pd.Series) -> str:
    """binary, categorical (at most ten whole-number levels) or continuous; a constant trait is an error."""
    levels = values.dropna().unique()
    if len(levels) < 2:
        raise ValueError("the trait does not vary")
    if len(levels) == 2:
        return "binary"
    return "categorical" if len(levels) <= 10 and np.all(levels == np.round(levels)) else "continuous"


@dataclass(frozen=True)
class Study:
    """Aligned input: cells (v_idx, s_idx, dosage) of the samples of ``table`` (iid, s_idx and traits, by s_idx) that have all that is needed."""

    cells: DataFrame
    variants: DataFrame
    stats: DataFrame
    table: pd.DataFrame
    manifest: DataFrame

    @property
    def samples(self) -> list[int]:
        return self.table["s_idx"].tolist()

    def design(self, covariates: list[str]) -> np.ndarray:
        return np.column_stack([np.ones(len(self.table)), *(self.table[c].to_numpy(float) for c in covariates)])

    def kinship(self, kind: str = "vanraden", ploidy: int = 2) -> np.ndarray:
        return kinship.relationship(self.cells, self.samples, kind, ploidy)


def study(spark: SparkSession, genotypes: str | readers.Genotypes, phenotypes: str | DataFrame, needed: list[str], ploidy: int = 2, limits: qc.Limits | None = qc.Limits(), gene_action: str = "additive") -> Study:
    """Genotypes and phenotypes of the samples that both have, numbered from 0 by name, the variants passing the limits."""
    g = readers.read_genotypes(spark, genotypes) if isinstance(genotypes, str) else genotypes
    pheno = readers.read_phenotypes(spark, phenotypes) if isinstance(phenotypes, str) else phenotypes
    genotyped = g.calls.select("iid").distinct()
    manifest = qc.alignment_manifest(genotyped, pheno.dropna(subset=needed), "iid")
    t = pheno.dropna(subset=needed).join(genotyped, "iid").orderBy("iid").toPandas()
    if len(t) < 2 + len(needed):
        raise ValueError("too few samples with genotypes, traits and covariates")
    t["s_idx"] = np.arange(len(t))
    ids = spark.createDataFrame(t[["iid", "s_idx"]])
    calls = g.calls.join(F.broadcast(ids), "iid").select("v_idx", "s_idx", encode.gene_action(F.col("dosage"), gene_action, ploidy).alias("dosage"))
    stats = qc.variant_stats(calls, len(t), ploidy)
    if limits is not None:
        stats = stats.where(qc.fail_reason(limits).isNull())
    return Study(calls.join(stats.select("v_idx"), "v_idx", "left_semi"), g.variants, stats, t, manifest)


def numbered(g: readers.Genotypes) -> tuple[DataFrame, list[str]]:
    """Calls with s_idx, the place of the sample's name among the sorted names, and these names."""
    names = [r["iid"] for r in g.calls.select("iid").distinct().orderBy("iid").collect()]
    ids = g.calls.sparkSession.createDataFrame(list(enumerate(names)), "s_idx long, iid string")
    return g.calls.join(F.broadcast(ids), "iid"), names


def recommend(spark: SparkSession, genotypes: str, phenotypes: str, trait: str, event: str | None = None) -> dict:
    """The model for a trait, by its type and the study's size, and why."""
    told = preflight(spark, genotypes, phenotypes)
    values = readers.read_phenotypes(spark, phenotypes).select(trait).toPandas()[trait]
    kind = "survival" if event else trait_type(values)
    related = told["n_both"] >= 100
    model = {"binary": ("glmm" if related else "logistic"), "categorical": ("ordinal_glmm" if related else "ordinal"), "continuous": "lmm", "survival": ("frailty" if related else "cox")}[kind]
    if kind == "continuous" and told["n_variants"] > 10 * told["n_both"]:
        model = "lmm_loco"
    return {"trait": kind, "model": model, "why": REGISTRY[model][1], "correction": "bh", **told}


def gwas(
    spark: SparkSession, genotypes: str | readers.Genotypes, phenotypes: str | DataFrame, trait: str, covariates: list[str] = (), model: str = "auto", ploidy: int = 2,
    limits: qc.Limits | None = qc.Limits(), gene_action: str = "additive", event: str | None = None, correction: str = "bh",
) -> Result:
    """Scan one trait. Covariates are columns of the phenotype table; event names the indicator of a survival trait."""
    if model not in MODELS:
        raise ValueError(f"model is one of {', '.join(MODELS)}")
    own = study(spark, genotypes, phenotypes, [trait, *covariates, *([event] if event else [])], ploidy, limits, gene_action)
    t = own.table
    kind = trait_type(t[trait]) if not event else "survival"
    if model == "auto":
        model = {"binary": "logistic", "categorical": "ordinal", "continuous": "lmm", "survival": "cox"}[kind]
    found = _scan(own.cells, own.variants, t, trait, list(covariates), model, ploidy, event)
    rows = found.join(own.variants, "v_idx").join(own.stats.select("v_idx", "af", "n_obs"), "v_idx").where(F.col("p").isNotNull() & ~F.isnan("p"))
    adjust = {"bh": multiple_testing.benjamini_hochberg, "by": multiple_testing.benjamini_yekutieli, "holm": multiple_testing.holm}
    rows = multiple_testing.bonferroni(rows) if correction == "bonferroni" else adjust[correction](rows, ["v_idx"])
    return Result(rows, own.manifest, model, len(t))


def _scan(cells: DataFrame, variants: DataFrame, t: pd.DataFrame, trait: str, covariates: list[str], model: str, ploidy: int, event: str | None) -> DataFrame:
    spark, samples = cells.sparkSession, t["s_idx"].tolist()
    y = t[trait].to_numpy(float)
    x = np.column_stack([np.ones(len(t)), *(t[c].to_numpy(float) for c in covariates)])
    if model == "glm" and not covariates:
        long = cells.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"s_idx": samples, "y": y}))), "s_idx")
        return scan.linear(long).withColumn("p", specfun.t_sf2_udf(F.col("stat"), (F.col("n") - 2).cast("double"))).drop("n")
    if model == "glm":
        fit = mixed.fit_null(y, x, np.eye(len(t)), samples)
        return mixed.scan(cells, fit)
    if model == "lmm":
        return mixed.scan(cells, mixed.fit_null(y, x, kinship.relationship(cells, samples, ploidy=ploidy), samples))
    if model == "lmm_refit":
        return mixed.scan_refit(cells, y, x, kinship.relationship(cells, samples, ploidy=ploidy), samples).drop("ratio")
    if model == "blink":
        return multilocus.blink(cells, samples, y, x)[0]
    if model == "farmcpu":
        return multilocus.farmcpu(cells, variants, samples, y, x)[0]
    if model == "lmm_loco":
        placed = cells.join(variants.select("v_idx", "chr"), "v_idx")
        parts = [mixed.scan(placed.where(F.col("chr") == c), mixed.fit_null(y, x, k, samples)) for c, k in sorted(kinship.leave_one_out(placed, samples, ploidy=ploidy).items())]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    levels = np.unique(y, return_inverse=True)[1]
    if model in ("glmm", "probit_glmm", "poisson_glmm"):
        family = {"glmm": "logit", "probit_glmm": "probit", "poisson_glmm": "log"}[model]
        return glmm.scan(cells, glmm.fit(y if family == "log" else levels.astype(float), x, kinship.relationship(cells, samples, ploidy=ploidy), samples, family))
    if model == "ordinal_glmm":
        return glmm.scan(cells, glmm.fit_ordinal(levels, x[:, 1:], kinship.relationship(cells, samples, ploidy=ploidy), samples))
    if model == "multinomial_glmm":
        return glmm.scan_multinomial(cells, glmm.fit_multinomial(levels, x, kinship.relationship(cells, samples, ploidy=ploidy), samples))
    if model in ("logistic", "firth"):
        return map_variants(cells, samples, glm.score_logistic, glm.fit_logistic(levels.astype(float), x, firth=model == "firth"), "beta double, se double, chi2 double, p double")
    if model == "ordinal":
        return map_variants(cells, samples, glm.score_ordinal, glm.fit_ordinal(levels, x[:, 1:]), "u double, chi2 double, p double")
    if model == "multinomial":
        return map_variants(cells, samples, glm.score_multinomial, glm.fit_multinomial(levels, x), "chi2 double, p double")
    if event is None:
        raise ValueError("a survival model needs the event column")
    if model == "frailty":
        return glmm.scan(cells, glmm.fit_survival(y, t[event].to_numpy(float), x[:, 1:], kinship.relationship(cells, samples, ploidy=ploidy), samples))
    return map_variants(cells, samples, glm.score_cox, glm.fit_cox(y, t[event].to_numpy(), x[:, 1:]), "beta double, chi2 double, p double")


def preflight(spark: SparkSession, genotypes: str, phenotypes: str) -> dict:
    """Counts and warnings before a scan: samples, overlap, duplicates, missingness, ploidy."""
    g, pheno = readers.read_genotypes(spark, genotypes), readers.read_phenotypes(spark, phenotypes)
    a = g.calls.agg(F.countDistinct("iid").alias("n_genotyped"), F.countDistinct("v_idx").alias("n_variants"), F.avg(F.col("dosage").isNull().cast("double")).alias("missing"), F.max("dosage").alias("most")).first()
    b = pheno.agg(F.count("*").alias("n"), F.countDistinct("iid").alias("d")).first()
    both = g.calls.select("iid").distinct().join(pheno.select("iid").distinct(), "iid").count()
    notes = []
    if b["n"] != b["d"]:
        notes.append("phenotype ids repeat")
    if both < 0.5 * a["n_genotyped"]:
        notes.append("fewer than half of the genotyped samples have phenotypes")
    return {"n_genotyped": a["n_genotyped"], "n_variants": a["n_variants"], "missing": a["missing"], "max_dosage": a["most"], "n_phenotyped": b["d"], "n_both": both, "warnings": notes}
