"""Commands: python -m lociframe.cli COMMAND ... ; results are written as Parquet, or as text for .tsv paths."""

from __future__ import annotations

import argparse
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import api
from lociframe.functions import specfun
from lociframe.operators import bayes, blocks, dprime, encode, env_curves, env_glmm, evidence, genetics_extra, intervals, kinship, ld, ld_cuts, liability, mediation, mixed, multilocus, multiple_testing, multitrait, pgs, prefix_copying, qc, scan, sumstats
from lociframe.sources import readers, writers


#: Results of commands that are called from Python, innermost last.
_results: list[list[DataFrame]] = []


def _write(df: DataFrame, path: str | None) -> None:
    if path is None:
        _results[-1].append(df)
    elif path.endswith(".tsv"):
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _names(told: str) -> list[str]:
    return [x for x in told.split(",") if x]


def _scan(spark: SparkSession, a: argparse.Namespace) -> None:
    found = api.gwas(spark, a.genotypes, a.phenotypes, a.trait, _names(a.covariates), a.model, a.ploidy, event=a.event or None)
    if a.out is None:
        _write(found.table, None)
    else:
        writers.write_association(found.table, a.out)


def _model(name: str):
    """A scan by one model of the facade."""

    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        a.model, a.event = name, getattr(a, "event", "")
        _scan(spark, a)

    return run


def _glmm(spark: SparkSession, a: argparse.Namespace) -> None:
    a.model, a.event = {"binary": "glmm", "probit": "probit_glmm", "ordinal": "ordinal_glmm", "multinomial": "multinomial_glmm", "poisson": "poisson_glmm"}[a.family], ""
    _scan(spark, a)


def _me_glmm(spark: SparkSession, a: argparse.Namespace) -> None:
    """The named traits are one trait in several environments."""
    s, y, x = _study(spark, a)
    if y.shape[1] < 2:
        raise ValueError("me-glmm-scan needs a trait for each of two environments or more")
    family = {"binary": "logit", "probit": "probit", "poisson": "log", "ordinal": "ordinal"}[a.family]
    fit = env_glmm.fit(y, x[:, 1:] if family == "ordinal" else x, s.kinship(ploidy=a.ploidy), s.samples, family)
    _named(env_glmm.scan(s.cells, fit), s, a.out)


def _study(spark: SparkSession, a: argparse.Namespace, extra: list[str] = ()) -> tuple[api.Study, np.ndarray, np.ndarray]:
    """The aligned study, its traits (one column for each name) and the design."""
    traits, covariates = _names(a.trait), _names(a.covariates)
    s = api.study(spark, a.genotypes, a.phenotypes, [*traits, *covariates, *extra], a.ploidy)
    return s, s.table[traits].to_numpy(float), s.design(covariates)


def _named(found: DataFrame, s: api.Study, path: str) -> None:
    _write(found.join(s.variants, "v_idx"), path)


def _mvlmm(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    _named(multitrait.scan(s.cells, multitrait.fit(y, x, s.kinship(ploidy=a.ploidy), s.samples)), s, a.out)


def _met(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    _named(multitrait.scan_environments(s.cells, multitrait.fit(y, x, s.kinship(ploidy=a.ploidy), s.samples, a.structure)), s, a.out)


def _mtmet(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    _named(multitrait.scan(s.cells, multitrait.fit(y, x, s.kinship(ploidy=a.ploidy), s.samples, "separable", (a.traits, y.shape[1] // a.traits))), s, a.out)


def _rr(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    coefficients = multitrait.random_regression(y, np.array([float(t) for t in _names(a.times)]), a.order)
    _named(multitrait.scan(s.cells, multitrait.fit(coefficients, x, s.kinship(ploidy=a.ploidy), s.samples)), s, a.out)


def _rr_met(spark: SparkSession, a: argparse.Namespace) -> None:
    """Long measures (IID, trait, time, environment) as curves; samples with a curve in some environment and genotypes."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(a.phenotypes).select(F.col("IID").alias("iid"), F.col(f"`{a.environment}`").alias("env"), *(F.col(f"`{c}`").try_cast("double").alias(n) for c, n in ((a.time, "time"), (a.trait, "value"))))
    basis = env_curves.pooled_basis(rows, "time", a.basis, a.order, a.knots)
    projected = env_curves.project(rows, basis, "iid", "env", "time", "value").where("coefficients is not null").persist()
    covariates = _names(a.covariates)
    own = readers.read_phenotypes(spark, a.phenotypes)
    who = own.groupBy("iid").agg(F.lit(1.0).alias("measured"), *(F.avg(f"`{c}`").alias(c) for c in covariates)).join(projected.select(F.col("who").alias("iid")).distinct(), "iid")
    s = api.study(spark, a.genotypes, who, ["measured", *covariates], a.ploidy)
    environments = [r[0] for r in projected.select("env").distinct().orderBy("env").collect()]
    y = env_curves.traits(projected, s.table["iid"].tolist(), environments, basis.size)
    fit = env_curves.fit(y, s.design(covariates), [s.kinship(ploidy=a.ploidy)], s.samples, environments, basis, a.structure)
    _named(env_curves.scan(s.cells, fit, tuple(float(t) for t in _names(a.at))), s, a.out)


def _threshold_linear(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ordered traits (levels 0, 1, ..) named in --ordinal and linear ones, jointly."""
    s, y, x = _study(spark, a)
    ordinal = [_names(a.trait).index(t) for t in _names(a.ordinal)]
    _named(liability.scan(s.cells, liability.fit(y, x, s.kinship(ploidy=a.ploidy), s.samples, ordinal)), s, a.out)


def _mklmm(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    additive, dominance = s.kinship(ploidy=a.ploidy), s.kinship("dominance", a.ploidy)
    kernels = [additive, dominance, *(kinship.epistatic(additive, dominance)[k] for k in _names(a.epistatic))]
    _named(multitrait.scan_kernels(s.cells, multitrait.fit_kernels(y[:, 0], x, kernels, s.samples)), s, a.out)


def _gxe(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a, [a.environment])
    z = s.table[a.environment].to_numpy(float)
    fit = multitrait.fit_kernels(y[:, 0], np.column_stack([x, z]), multitrait.interaction_kernels(s.kinship(ploidy=a.ploidy), z - z.mean()), s.samples)
    _named(multitrait.scan_gxe(s.cells, fit, z), s, a.out)


def _poly(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every gene action of the ploidy, and for each variant the one that fits best."""
    scans = None
    for action in (m for m in encode.gene_action_models(a.ploidy) if m != "general"):
        s = api.study(spark, a.genotypes, a.phenotypes, [*_names(a.trait), *_names(a.covariates)], a.ploidy, None, action)
        fit = mixed.fit_null(s.table[a.trait].to_numpy(float), s.design(_names(a.covariates)), kinship.relationship(s.cells, s.samples, ploidy=max(1, a.ploidy)), s.samples)
        one = mixed.scan(s.cells, fit).withColumns({"model": F.lit(action), "k": F.lit(1)})
        scans = one if scans is None else scans.unionByName(one)
    _named(scans.where(~F.isnan("p")), s, a.out)


def _set(spark: SparkSession, a: argparse.Namespace) -> None:
    """SKAT, burden and SKAT-O of the variants of each region of a BED file."""
    s, y, x = _study(spark, a)
    fit = mixed.fit_null(y[:, 0], x, s.kinship(ploidy=a.ploidy), s.samples)
    shared = spark.sparkContext.broadcast(fit)
    hit = intervals.range_join(s.variants, readers.read_regions(spark, a.regions), "start", "end").select("region", "v_idx")
    rows = hit.join(encode.impute_mean(s.cells), "v_idx").join(s.stats.select("v_idx", readers.set_weights(F.col("af")).alias("weight")), "v_idx")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="s_idx", columns="v_idx", values="dosage").reindex(list(shared.value.samples)).fillna(0.0)
        weights = group.drop_duplicates("v_idx").set_index("v_idx")["weight"][wide.columns].to_numpy()
        found = mixed.set_tests(shared.value, wide.to_numpy(float), weights)
        return pd.DataFrame({"region": [group["region"].iloc[0]], "n_variants": [wide.shape[1]]} | {k: [v] for k, v in found.items()})

    _write(rows.groupBy("region").applyInPandas(run, "region string, n_variants long, q_skat double, p_skat double, p_burden double, p_skato double"), a.out)


def _family(spark: SparkSession, a: argparse.Namespace) -> None:
    s, _, _ = _study(spark, a, [a.family])
    own = spark.createDataFrame(s.table[["s_idx", a.trait, a.family]].rename(columns={a.trait: "y", a.family: "family"}))
    _named(scan.within_family(s.cells.join(F.broadcast(own), "s_idx")), s, a.out)


def _conditional(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    _named(multilocus.conditional_leads(s.cells, s.samples, y[:, 0], x, a.p, a.most, s.kinship(ploidy=a.ploidy)), s, a.out)


def _ocf(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    _named(multilocus.cross_fitted(s.cells, s.samples, y[:, 0], x, a.folds), s, a.out)


def _knockoff(spark: SparkSession, a: argparse.Namespace) -> None:
    s, y, x = _study(spark, a)
    w = multilocus.knockoff_statistics(s.cells, s.variants, s.samples, y[:, 0], x, a.window, s.kinship(ploidy=a.ploidy))
    _named(multiple_testing.knockoff_filter(w, "w", a.q), s, a.out)


def _bayes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Inclusion probabilities from a mixed-model scan's scores and the study's own LD, by chromosome."""
    s, y, x = _study(spark, a)
    found = mixed.scan(s.cells, mixed.fit_null(y[:, 0], x, s.kinship(ploidy=a.ploidy), s.samples)).where("NOT isnan(beta) AND se > 0")
    stats = found.join(s.variants, "v_idx").select("v_idx", F.col("chr").alias("block"), (F.col("beta") / F.col("se")).alias("z"), F.lit(float(len(s.samples))).alias("n"))
    _named(bayes.finemap(stats, ld.pair_correlations(s.cells, s.variants, a.window), a.layers), s, a.out)


def _preflight(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(api.preflight(spark, a.genotypes, a.phenotypes)))


def _recommend(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(api.recommend(spark, a.genotypes, a.phenotypes, a.trait, a.event or None)))


def _models(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, (trait, what) in api.REGISTRY.items():
        print(f"{name}\t{trait}\t{what}")


def _genotypes(spark: SparkSession, a: argparse.Namespace) -> tuple[readers.Genotypes, DataFrame, list[str]]:
    """Genotypes, calls with s_idx, and the samples' names."""
    g = readers.read_genotypes(spark, a.genotypes)
    calls, names = api.numbered(g)
    return g, calls, names


def _qc(spark: SparkSession, a: argparse.Namespace) -> None:
    g, calls, names = _genotypes(spark, a)
    stats = qc.variant_stats(calls, len(names), a.ploidy)
    _write(stats.withColumn("fail_reason", qc.fail_reason()).join(g.variants, "v_idx"), a.out)


def _pairs(spark: SparkSession, a: argparse.Namespace) -> tuple[readers.Genotypes, DataFrame, DataFrame]:
    g, calls, _ = _genotypes(spark, a)
    return g, calls, ld.pair_correlations(calls, g.variants, a.window)


def _ld_scores(spark: SparkSession, a: argparse.Namespace) -> None:
    g, _, pairs = _pairs(spark, a)
    _write(ld.scores(pairs, g.variants).join(g.variants, "v_idx"), a.out)


def _ld_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(_pairs(spark, a)[2], a.out)


def _ld_blocks(spark: SparkSession, a: argparse.Namespace) -> None:
    g, calls, pairs = _pairs(spark, a)
    needs = blocks.NEEDS.get(a.method)
    if needs == "dprime":
        found = dprime.pair_dprime(ld.genotype_tables(calls, g.variants, a.window)).select("i", "j", "dprime", "low", "high")
        pairs = pairs.join(found, ["i", "j"])
    rows = blocks.detect(g.variants, pairs, a.method, calls if needs == "calls" else None)
    if a.det:
        writers.write_blocks_det(rows, g.variants, a.det)
    _write(rows, a.out)


def _clump(spark: SparkSession, a: argparse.Namespace) -> None:
    g, _, pairs = _pairs(spark, a)
    hits = readers.read_sumstats(spark, a.sumstats).select("snp", "p").join(g.variants, "snp")
    _write(ld.clump(hits, pairs, a.p, a.r2), a.out)


def _grm(spark: SparkSession, a: argparse.Namespace) -> None:
    _, calls, names = _genotypes(spark, a)
    found = kinship.gram_pairs(kinship.encoded(calls.select("v_idx", "s_idx", "dosage"), a.kind, a.ploidy), list(range(len(names))))
    ids = spark.createDataFrame(list(enumerate(names)), "k_idx long, iid string")
    first, second = ids.select(F.col("k_idx").alias("i"), F.col("iid").alias("iid_i")), ids.select(F.col("k_idx").alias("j"), F.col("iid").alias("iid_j"))
    _write(found.where(F.abs("k") >= a.threshold).join(first, "i").join(second, "j").select("iid_i", "iid_j", "k"), a.out)


def _impute(spark: SparkSession, a: argparse.Namespace) -> None:
    g, calls, names = _genotypes(spark, a)
    ids = spark.createDataFrame(list(enumerate(names)), "s_idx long, iid string")
    cells = encode.dense(calls, g.variants, ids)
    if a.method == "knn":
        done = genetics_extra.impute_knn(cells, kinship.nearest(kinship.encoded(cells, ploidy=a.ploidy), 5, len(names)))
    elif a.method == "copying":
        done = genetics_extra.impute_copying(cells, g.variants)
    elif a.method == "prefix":
        done = prefix_copying.impute(cells, g.variants)
    else:
        done = {"mean": encode.impute_mean, "mode": encode.impute_mode, "ld": evidence.impute_from_neighbours}[a.method](cells)
    _write(done.join(ids, "s_idx").select("v_idx", "iid", "dosage"), a.out)


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    g, _, names = _genotypes(spark, a)
    if a.to == "vcf":
        writers.write_vcf(g.variants, g.calls, names, a.out)
    elif a.to == "bed":
        writers.write_plink(g.variants, g.calls, names, a.out)
    else:
        g.variants.write.mode("overwrite").parquet(f"{a.out}/variants")
        g.calls.write.mode("overwrite").parquet(f"{a.out}/calls")


def _meta(spark: SparkSession, a: argparse.Namespace) -> None:
    """Variants of any study take part; alleles are turned to those of the first study that has the variant."""
    tables = [readers.read_sumstats(spark, p).withColumn("__study", F.lit(k)) for k, p in enumerate(_names(a.sumstats))]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    reference = every.groupBy("snp").agg(F.min_by(F.struct("a1", "a2"), "__study").alias("r")).select("snp", "r.a1", "r.a2")
    rows = sumstats.align(reference, every).select("snp", "beta", "se").where("beta IS NOT NULL AND se > 0")
    _write((sumstats.meta_random if a.random else sumstats.meta_fixed)(rows), a.out)


def _two(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    x, y = readers.read_sumstats(spark, a.exposure), readers.read_sumstats(spark, a.outcome)
    return x, sumstats.align(x, y)


def _mr(spark: SparkSession, a: argparse.Namespace) -> None:
    x, y = _two(spark, a)
    inst = sumstats.instruments(x.where(F.col("p") <= a.p), y)
    ivw, egger = sumstats.mr_ivw(inst).first(), sumstats.mr_egger(inst).first()
    median = sumstats.mr_weighted_median(inst).first()
    rows = [("ivw", ivw["beta"], ivw["se"]), ("egger", egger["slope"], egger["se_slope"]), ("weighted_median", median["beta"] if median else None, None)]
    _write(spark.createDataFrame(rows, "method string, beta double, se double"), a.out)


def _coloc(spark: SparkSession, a: argparse.Namespace) -> None:
    x, y = _two(spark, a)
    _write(sumstats.coloc(sumstats.instruments(x, y).join(x.select("snp", "chr"), "snp"), ["chr"]), a.out)


def _smr(spark: SparkSession, a: argparse.Namespace) -> None:
    """eQTL statistics of one gene for each chromosome-wide probe column ``gene``, or one probe for each chromosome."""
    x, y = _two(spark, a)
    inst = sumstats.instruments(x, y).join(x.select("snp", F.col("chr").alias("gene")), "snp")
    rows = sumstats.smr(inst).join(sumstats.heidi(inst), "gene", "left")
    _write(rows.withColumn("p", specfun.chi2_sf_udf("chi2", F.lit(1.0))), a.out)


def _mr_mega(spark: SparkSession, a: argparse.Namespace) -> None:
    names = _names(a.sumstats)
    tables = [readers.read_sumstats(spark, p) for p in names]
    studies = [f"s{k}" for k in range(len(names))]
    reference, rows, wide = tables[0], None, None
    for name, t in zip(studies, tables, strict=True):
        own = sumstats.align(reference, t)
        one = own.select("snp", F.lit(name).alias("study"), "beta", "se")
        rows = one if rows is None else rows.unionByName(one)
        af = own.select("snp", F.col("af").alias(name))
        wide = af if wide is None else wide.join(af, "snp")
    _write(genetics_extra.mr_mega(rows, studies, genetics_extra.ancestry_axes(wide.drop("snp"), studies, a.axes)), a.out)


def _stats_of(spark: SparkSession, g: readers.Genotypes, path: str, n: float | None = None) -> DataFrame:
    """(v_idx, chr, z, n) of summary statistics on the alleles of a genotype panel; n must be known, since all that follows depends on it."""
    own = sumstats.harmonize(g.variants, readers.read_sumstats(spark, path).withColumn("af", F.coalesce("af", F.lit(0.0)))).where(~F.col("status").isin("ambiguous", "mismatch"))
    z = F.col("beta") * F.col("sign") / F.col("se")
    rows = own.select("snp", z.alias("z"), F.coalesce("n", F.lit(n)).alias("n")).join(g.variants.select("snp", "v_idx", "chr"), "snp").where("z IS NOT NULL")
    if not rows.where("n IS NULL OR n <= 0").isEmpty():
        raise SystemExit(f"{path} lacks sample sizes; give --n")
    return rows


def _panel(work, cut: bool = False):
    """A command on summary statistics and the LD of a genotype panel, in blocks of least LD between them where the work is by block."""

    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        g, _, pairs = _pairs(spark, a)
        stats = _stats_of(spark, g, a.sumstats, a.n or None)
        if cut:
            stats = stats.join(ld_cuts.blocks(g.variants, pairs, a.block_least, a.block_most).select("v_idx", "block"), "v_idx")
        found = work(spark, a, g, stats, pairs)
        _write(found.join(g.variants, "v_idx") if "v_idx" in found.columns else found, a.out)

    return run


def _ldsc_h2(spark: SparkSession, a: argparse.Namespace, g: readers.Genotypes, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = stats.join(ld.scores(pairs, g.variants), "v_idx").select(F.col("v_idx").alias("at"), (F.col("z") * F.col("z")).alias("chi2"), "ld_score", "n")
    return bayes.ldsc(rows, a.m or g.variants.count(), a.blocks)


def _ldsc_rg(spark: SparkSession, a: argparse.Namespace, g: readers.Genotypes, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    other = _stats_of(spark, g, a.other, a.n or None).select("v_idx", F.col("z").alias("z2"), F.col("n").alias("n2"))
    rows = stats.select("v_idx", F.col("z").alias("z1"), F.col("n").alias("n1")).join(other, "v_idx").join(ld.scores(pairs, g.variants), "v_idx")
    return genetics_extra.ldsc_covariance(rows, a.m or g.variants.count())


def _adjust(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_sumstats(spark, a.sumstats).where("p IS NOT NULL")
    work = {"bh": multiple_testing.benjamini_hochberg, "by": multiple_testing.benjamini_yekutieli, "holm": multiple_testing.holm, "storey": multiple_testing.storey}
    _write(work[a.method](rows, ["snp"]), a.out)


def _power(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = sumstats.power_ncp(readers.read_sumstats(spark, a.sumstats))
    cut = F.lit(float(specfun.norm_ppf(1 - a.alpha / 2)[0]))
    root = F.sqrt("ncp")
    _write(rows.withColumn("power", specfun.norm_cdf_udf(root - cut) + specfun.norm_cdf_udf(-root - cut)), a.out)


def _winners_curse(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_sumstats(spark, a.sumstats).where("se > 0")
    _write(evidence.fiqt(rows, ["snp"]) if a.method == "fiqt" else evidence.winners_curse(rows, a.alpha), a.out)


def _genes(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_regions(spark, path).withColumnRenamed("region", "gene")


def _enrichment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Gene scores are mean |z| of the variants in and near a gene; sets is a table of gene and gene_set."""
    wide = _genes(spark, a.genes).withColumns({"lo": F.col("start") - a.window, "hi": F.col("end") + a.window}).select("gene", "chr", "lo", "hi")
    hit = intervals.range_join(readers.read_sumstats(spark, a.sumstats).select("chr", "pos", (F.abs("beta") / F.col("se")).alias("z")), wide, "lo", "hi", closed=True)
    genes = hit.groupBy("gene").agg(F.count("*").alias("k"), F.avg("z").alias("z"))
    _write(evidence.gene_set_enrichment(genes, spark.read.option("sep", "\t").option("header", True).csv(a.sets)), a.out)


def _annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    hits = readers.read_sumstats(spark, a.sumstats).where(F.col("p") <= a.p)
    wide = _genes(spark, a.genes).withColumns({"lo": F.col("start") - a.window, "hi": F.col("end") + a.window})
    near = intervals.range_join(hits, wide, "lo", "hi", closed=True)
    gap = F.greatest(F.lit(0), F.col("start") - F.col("pos"), F.col("pos") - F.col("end"))
    _write(near.select("snp", "chr", "pos", "p", "gene", gap.alias("distance")), a.out)


def _twas(spark: SparkSession, a: argparse.Namespace) -> None:
    weights = readers.read_weight_database(spark, a.weights).select("gene", F.col("rsid").alias("snp"), "weight", "ref_allele", "eff_allele")
    own = readers.read_sumstats(spark, a.sumstats).join(weights, "snp")
    sign = F.when(F.col("a1") == F.upper("eff_allele"), 1).when(F.col("a1") == F.upper("ref_allele"), -1)
    found = sumstats.twas(own.select("gene", "snp", "weight"), own.select("snp", (F.col("beta") * sign).alias("beta"), "se").where("beta IS NOT NULL").dropDuplicates(["snp"]), by="snp")
    _write(found.withColumn("p", 2 * specfun.norm_cdf_udf(-F.abs("z"))), a.out)


def _combine(spark: SparkSession, a: argparse.Namespace) -> None:
    from lociframe.operators.combine import cauchy_sf, cauchy_term

    wide = _genes(spark, a.genes).withColumns({"lo": F.col("start") - a.window, "hi": F.col("end") + a.window}).select("gene", "chr", "lo", "hi")
    best = intervals.range_join(readers.read_sumstats(spark, a.sumstats).select("chr", "pos", "p"), wide, "lo", "hi", closed=True).groupBy("gene").agg(F.min("p").alias("p_gwas"))
    twas = (spark.read.option("sep", "\t").option("header", True).csv(a.twas) if a.twas.endswith(".tsv") else spark.read.parquet(a.twas)).select("gene", F.col("p").cast("double").alias("p_twas"))
    both = best.join(twas, "gene").withColumn("t", (cauchy_term(F.col("p_gwas")) + cauchy_term(F.col("p_twas"))) / 2)
    _write(both.select("gene", "p_gwas", "p_twas", cauchy_sf(F.col("t")).alias("p_combined")), a.out)


def _mediate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sobel's test of each variant through a mediator that is a column of the phenotypes."""
    s, _, _ = _study(spark, a, [a.mediator])
    own = spark.createDataFrame(s.table[["s_idx", a.trait, a.mediator]].rename(columns={a.trait: "y", a.mediator: "m"}))
    _named(mediation.sobel(s.cells.where("dosage IS NOT NULL").join(F.broadcast(own), "s_idx").withColumnRenamed("dosage", "x"), ["v_idx"]), s, a.out)


def _mediate_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every feature of an expression table (iid, gene columns) as mediator of the variants near its gene."""
    s, _, _ = _study(spark, a)
    table = spark.read.option("sep", "\t").option("header", True).csv(a.expression)
    key, genes = table.columns[0], table.columns[1:]
    long = table.select(F.col(key).alias("iid"), F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").try_cast("double").alias("m")) for g in genes))).alias("e")).select("iid", "e.*")
    wide = _genes(spark, a.genes).withColumns({"lo": F.col("start") - a.window, "hi": F.col("end") + a.window}).select("gene", "chr", "lo", "hi")
    near = intervals.range_join(s.variants, wide, "lo", "hi", closed=True).select("gene", "v_idx")
    own = spark.createDataFrame(s.table[["s_idx", "iid", a.trait]].rename(columns={a.trait: "y"}))
    rows = near.join(s.cells.where("dosage IS NOT NULL"), "v_idx").join(F.broadcast(own), "s_idx").join(long, ["iid", "gene"]).withColumnRenamed("dosage", "x")
    _named(mediation.sobel(rows, ["gene", "v_idx"]), s, a.out)


def _pgs_fit(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.method == "ct":
        g, _, pairs = _pairs(spark, a)
        stats = readers.read_sumstats(spark, a.sumstats)
        hits = stats.select("snp", "p").join(g.variants, "snp")
        leads = ld.clump(hits, pairs, a.p, a.r2).select(F.col("index").alias("v_idx")).distinct().join(g.variants, "v_idx")
        _write(leads.join(stats.select("snp", F.col("beta").alias("weight")), "snp").select("v_idx", "snp", "chr", "pos", "a1", "a2", "weight"), a.out)
        return
    _panel(lambda spark, a, g, stats, pairs: bayes.polygenic_weights(stats, pairs, a.method, a.h2, a.share), True)(spark, a)


def _pgs(spark: SparkSession, a: argparse.Namespace) -> None:
    g = readers.read_genotypes(spark, a.genotypes)
    weights = readers.read_sumstats(spark, a.weights).withColumn("af", F.coalesce("af", F.lit(0.0)))
    usable = sumstats.harmonize(g.variants, weights).where(~F.col("status").isin("ambiguous", "mismatch"))
    w = usable.select("snp", (F.col("beta") * F.col("sign")).alias("weight")).join(g.variants.select("snp", "v_idx"), "snp")
    _write(pgs.score(g.calls.withColumnRenamed("iid", "s_idx"), w), a.out)


def _pipeline(spark: SparkSession, a: argparse.Namespace) -> None:
    """Checks, quality control, a scan by the recommended model and its leading variants, each in a folder of the output."""
    told = api.recommend(spark, a.genotypes, a.phenotypes, a.trait)
    spark.createDataFrame([(json.dumps(told),)], "report string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    found = api.gwas(spark, a.genotypes, a.phenotypes, a.trait, _names(a.covariates), told["model"], a.ploidy)
    writers.write_manifest(found.manifest, f"{a.out}/manifest")
    writers.write_association(found.table, f"{a.out}/scan")
    _write(ld.prune_peaks(found.table.select("v_idx", "chr", "pos", "p"), a.p, a.window).join(found.table.select("v_idx", "snp"), "v_idx"), f"{a.out}/peaks")


STUDY = {"genotypes": None, "phenotypes": None, "trait": None, "covariates": "", "ploidy": 2}
PANEL = {"genotypes": None, "sumstats": None, "window": 1_000_000, "n": 0.0}
#: Blocks of a method that works by LD block: variants of one, least and most.
CUT = PANEL | {"block_least": 200, "block_most": 2000}
#: Command: (function, its options with defaults; None is required).
COMMANDS = {
    "scan": (_scan, STUDY | {"model": "auto", "event": ""}),
    "gwas": (_scan, STUDY | {"model": "auto", "event": ""}),
    "glm-scan": (_model("glm"), STUDY),
    "lmm-scan": (_model("lmm"), STUDY),
    "blink-scan": (_model("blink"), STUDY),
    "farmcpu-scan": (_model("farmcpu"), STUDY),
    "threshold-scan": (_model("ordinal_glmm"), STUDY),
    "glmm-scan": (_glmm, STUDY | {"family": "binary"}),
    "survival-scan": (_model("frailty"), STUDY | {"event": None}),
    "mvlmm-scan": (_mvlmm, STUDY),
    "met-scan": (_met, STUDY | {"structure": "unstructured"}),
    "me-glmm-scan": (_me_glmm, STUDY | {"family": "binary"}),
    "mtmet-scan": (_mtmet, STUDY | {"traits": 2}),
    "rr-scan": (_rr, STUDY | {"times": None, "order": 1}),
    "rr-met-scan": (_rr_met, STUDY | {"time": None, "environment": None, "basis": "legendre", "order": 1, "knots": 4, "structure": "separable", "at": ""}),
    "threshold-linear-scan": (_threshold_linear, STUDY | {"ordinal": None}),
    "mklmm-scan": (_mklmm, STUDY | {"epistatic": ""}),
    "gxe-scan": (_gxe, STUDY | {"environment": None}),
    "poly-scan": (_poly, STUDY),
    "set-scan": (_set, STUDY | {"regions": None}),
    "bayes-scan": (_bayes, STUDY | {"window": 1_000_000, "layers": 10}),
    "family-scan": (_family, STUDY | {"family": None}),
    "conditional-scan": (_conditional, STUDY | {"p": 5e-8, "most": 5}),
    "ocf-scan": (_ocf, STUDY | {"folds": 5}),
    "knockoff-scan": (_knockoff, STUDY | {"window": 1_000_000, "q": 0.1}),
    "mediate": (_mediate, STUDY | {"mediator": None}),
    "mediate-scan": (_mediate_scan, STUDY | {"expression": None, "genes": None, "window": 1_000_000}),
    "pipeline": (_pipeline, STUDY | {"p": 5e-8, "window": 500_000}),
    "validate": (_preflight, {"genotypes": None, "phenotypes": None}),
    "preflight": (_preflight, {"genotypes": None, "phenotypes": None}),
    "recommend": (_recommend, {"genotypes": None, "phenotypes": None, "trait": None, "event": ""}),
    "models": (_models, {}),
    "manifest": (lambda spark, a: print(json.dumps(manifest())), {}),
    "qc": (_qc, {"genotypes": None, "ploidy": 2}),
    "convert": (_convert, {"genotypes": None, "to": "parquet"}),
    "impute": (_impute, {"genotypes": None, "method": "mean", "ploidy": 2}),
    "grm": (_grm, {"genotypes": None, "kind": "vanraden", "ploidy": 2, "threshold": 0.0}),
    "ld-pairs": (_ld_pairs, {"genotypes": None, "window": 200_000}),
    "ld-scores": (_ld_scores, {"genotypes": None, "window": 1_000_000}),
    "ld-blocks": (_ld_blocks, {"genotypes": None, "window": 200_000, "method": "gabriel", "det": ""}),
    "clump": (_clump, {"genotypes": None, "sumstats": None, "window": 250_000, "p": 5e-8, "r2": 0.1}),
    "finemap": (_panel(lambda spark, a, g, stats, pairs: bayes.finemap(stats, pairs, a.layers), True), CUT | {"layers": 10}),
    "bayes-scan-rss": (_panel(lambda spark, a, g, stats, pairs: bayes.finemap(stats, pairs, a.layers), True), CUT | {"layers": 10}),
    "hess": (_panel(lambda spark, a, g, stats, pairs: bayes.hess(stats, pairs), True), CUT),
    "ldsc": (_panel(_ldsc_h2), PANEL | {"m": 0, "blocks": 200}),
    "ldsc-rg": (_panel(_ldsc_rg), PANEL | {"m": 0, "other": None}),
    "pgs-fit": (_pgs_fit, CUT | {"method": "inf", "h2": 0.3, "share": 0.1, "p": 5e-8, "r2": 0.1}),
    "pgs-score": (_pgs, {"genotypes": None, "weights": None}),
    "meta": (_meta, {"sumstats": None, "random": 0}),
    "mr": (_mr, {"exposure": None, "outcome": None, "p": 5e-8}),
    "mr-mega": (_mr_mega, {"sumstats": None, "axes": 1}),
    "coloc": (_coloc, {"exposure": None, "outcome": None}),
    "smr": (_smr, {"exposure": None, "outcome": None}),
    "adjust": (_adjust, {"sumstats": None, "method": "bh"}),
    "power": (_power, {"sumstats": None, "alpha": 0.05}),
    "winners-curse": (_winners_curse, {"sumstats": None, "method": "conditional", "alpha": 0.05}),
    "gene-set-enrichment": (_enrichment, {"sumstats": None, "genes": None, "sets": None, "window": 10_000}),
    "annotate": (_annotate, {"sumstats": None, "genes": None, "p": 5e-8, "window": 0}),
    "twas-scan": (_twas, {"sumstats": None, "weights": None}),
    "combine-gwas-twas": (_combine, {"sumstats": None, "twas": None, "genes": None, "window": 500_000}),
}


def call(spark: SparkSession, command: str, **options) -> DataFrame | None:
    """A command's table without writing it; options as on the command line, with _ for -. None for commands that only print or write."""
    _, defaults = COMMANDS[command]
    given = {k.replace("_", "-") if k.replace("_", "-") in defaults else k: v for k, v in options.items()}
    if unknown := given.keys() - defaults.keys() - {"out"}:
        raise TypeError(f"{command} has no option {', '.join(sorted(unknown))}")
    if missing := [k for k, v in defaults.items() if v is None and k not in given]:
        raise TypeError(f"{command} needs {', '.join(missing)}")
    _results.append([])
    try:
        COMMANDS[command][0](spark, argparse.Namespace(**{"out": None} | defaults | given))
        return _results[-1][-1] if _results[-1] else None
    finally:
        _results.pop()


def manifest() -> dict[str, dict]:
    """Every command with what it does and its options: type, default, whether it must be given."""
    return {
        name: {"help": (work.__doc__ or name).strip().split("\n")[0], "options": {k: {"type": type(v).__name__ if v is not None else "str", "default": v, "required": v is None} for k, v in options.items()}}
        for name, (work, options) in COMMANDS.items()
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lociframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        own = commands.add_parser(name)
        own.add_argument("--out", default="")
        for option, default in options.items():
            own.add_argument(f"--{option}", required=default is None, default=default, type=type(default) if default is not None else str)
    args = parser.parse_args(argv)
    session = spark or SparkSession.builder.appName("lociframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[args.command][0](session, args)


if __name__ == "__main__":
    main()
