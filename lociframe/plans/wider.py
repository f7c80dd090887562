"""Queries: cross-trait regression, ancestry meta-regression, imputation by relatives and by copying."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import genetics_extra, haplotypes, hypotheses, intervals, kinship, ld, mixed, prefix_copying, qc, thin

from . import views
from .catalogue import register
from .core import STATS, cells, r, stats
from .models import GRM, sample_ids
from .post import BOTH, SCORE_PAIRS, SCORE_WINDOW, pairs
from .tails import norm_ppf
from .views import cte


SCORES = SCORE_PAIRS + BOTH + f""", studies AS ({views.SQL["studies"]}), l AS (SELECT v_idx, 1 + coalesce(sum(r2), 0) AS l FROM variants LEFT JOIN both_ways USING (v_idx) GROUP BY 1) """


@register(
    "ldsc_rg",
    SCORES + """, x AS (SELECT a.beta / a.se AS z1, b.beta / b.se AS z2, a.n AS n1, b.n AS n2, l FROM studies a JOIN studies b USING (v_idx) JOIN l USING (v_idx) WHERE a.study = 'N' AND b.study = 'R'),
    m AS (SELECT regr_slope(z1 * z2, sqrt(n1 * n2) * l) * 200 AS c, regr_slope(z1 * z1, n1 * l) * 200 AS h1, regr_slope(z2 * z2, n2 * l) * 200 AS h2, regr_intercept(z1 * z2, sqrt(n1 * n2) * l) AS i FROM x)
    SELECT round(c, 5) AS covariance, round(h1, 5) AS h2_1, round(h2, 5) AS h2_2, round(c / sqrt(abs(h1 * h2)), 5) AS rg, round(i, 5) AS intercept FROM m""",
)
def ldsc_rg(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.studies(spark, sf).withColumn("z", F.col("beta") / F.col("se"))
    a = rows.where("study = 'N'").select("v_idx", F.col("z").alias("z1"), F.col("n").alias("n1"))
    b = rows.where("study = 'R'").select("v_idx", F.col("z").alias("z2"), F.col("n").alias("n2"))
    return genetics_extra.ldsc_covariance(a.join(b, "v_idx").join(ld.scores(pairs(spark, sf, SCORE_WINDOW), views.variants(spark, sf)), "v_idx"), 200).select(*(r(c, 5) for c in ("covariance", "h2_1", "h2_2", "rg", "intercept")))


@register(
    "sldsc_h2",
    SCORES + """, x AS (SELECT (beta / se) ** 2 AS y, n * CASE WHEN v_idx % 3 = 0 THEN l ELSE 0 END AS a, n * CASE WHEN v_idx % 3 <> 0 THEN l ELSE 0 END AS b, 1 / greatest(l, 1) AS w FROM studies JOIN l USING (v_idx) WHERE study = 'N'),
    s AS (SELECT sum(w) AS w, sum(w * a) AS a, sum(w * b) AS b, sum(w * y) AS y FROM x),
    cc AS (SELECT x.w AS w, x.a - s.a / s.w AS a, x.b - s.b / s.w AS b, x.y - s.y / s.w AS y FROM x, s),
    m AS (SELECT sum(w * a * a) AS aa, sum(w * a * b) AS ab, sum(w * b * b) AS bb, sum(w * a * y) AS ay, sum(w * b * y) AS by_ FROM cc),
    t AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ta, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS tb FROM m),
    u AS (SELECT 'coding' AS annotation, ta AS tau, 67.0 AS m, 67 * ta + 133 * tb AS whole FROM t UNION ALL SELECT 'other', tb, 133.0, 67 * ta + 133 * tb FROM t)
    SELECT annotation, round(tau, 7) AS tau, round(tau * m, 5) AS h2, round(tau * m / whole / (m / 200), 4) AS enrichment FROM u""",
)
def sldsc_h2(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pvals(spark, sf).withColumn("chi2", F.pow(F.col("beta") / F.col("se"), 2)).join(ld.scores(pairs(spark, sf, SCORE_WINDOW), views.variants(spark, sf)), "v_idx")
    rows = rows.withColumns({"coding": F.when(F.col("v_idx") % 3 == 0, F.col("ld_score")).otherwise(0.0), "other": F.when(F.col("v_idx") % 3 != 0, F.col("ld_score")).otherwise(0.0)})
    return genetics_extra.partitioned_heritability(rows, ["coding", "other"], {"coding": 67.0, "other": 133.0}).select("annotation", r("tau", 7), r("h2", 5), r("enrichment", 4))


@register("mr_mega")
def mr_mega(spark: SparkSession, sf: str) -> DataFrame:
    g = views.geno(spark, sf)
    names = ["A", "N", "R"]
    parts = [qc.allele_frequency(g.where(F.col("s_idx") % 3 == k)).withColumnRenamed("af", s) for k, s in enumerate(names)]
    axes = genetics_extra.ancestry_axes(parts[0].join(parts[1], "v_idx").join(parts[2], "v_idx"), names)
    return genetics_extra.mr_mega(views.studies(spark, sf), names, axes)


@register(
    "impute_knn",
    GRM.format(where="") + """, k AS (SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 9) AS k FROM e a JOIN e b USING (v_idx), norm WHERE a.s_idx <> b.s_idx GROUP BY 1, 2),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY k DESC, j) AS place FROM k) WHERE place <= 5),
    g AS (SELECT m.v_idx, m.s_idx, sum(greatest(k, 0) * o.dosage) / nullif(sum(greatest(k, 0)), 0) AS guess, avg(o.dosage) AS plain FROM cells m JOIN near ON near.i = m.s_idx JOIN cells o ON o.v_idx = m.v_idx AND o.s_idx = near.j
      WHERE m.dosage IS NULL AND o.dosage IS NOT NULL GROUP BY 1, 2)
    SELECT v_idx, s_idx, round(coalesce(dosage, guess, plain, avg(dosage) OVER (PARTITION BY v_idx)), 5) AS dosage FROM cells LEFT JOIN g USING (v_idx, s_idx)""",
)
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    near = kinship.nearest(kinship.encoded(c), 5, views.samples(spark, sf).count())
    return genetics_extra.impute_knn(c, near).withColumn("dosage", F.round("dosage", 5))


@register("impute_prefix")
def impute_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The copying model on the 50 samples that match each one best."""
    return prefix_copying.impute(cells(spark, sf), views.variants(spark, sf), 50, window=10_000)


@register("impute_copying")
def impute_copying(spark: SparkSession, sf: str) -> DataFrame:
    return genetics_extra.impute_copying(cells(spark, sf), views.variants(spark, sf), 10_000)


def _half(k: int) -> str:
    return f"(SELECT a.v_idx AS i, b.v_idx AS j, corr(a.dosage, b.dosage) AS r FROM c a JOIN c b ON a.chr = b.chr AND a.s_idx = b.s_idx AND b.pos > a.pos WHERE a.s_idx % 2 = {k} GROUP BY 1, 2 HAVING var_pop(a.dosage) > 1e-12 AND var_pop(b.dosage) > 1e-12)"


@register(
    "ld_cross_scores",
    cte("geno", "variants") + f""", c AS (SELECT * FROM geno JOIN variants USING (v_idx)), x AS (SELECT a.i, a.j, a.r * b.r AS x FROM {_half(0)} a JOIN {_half(1)} b USING (i, j)),
    s AS (SELECT v_idx, sum(x) AS s FROM (SELECT i AS v_idx, x FROM x UNION ALL SELECT j, x FROM x) GROUP BY 1) SELECT v_idx, round(1 + coalesce(s, 0), 5) AS cross_score FROM variants LEFT JOIN s USING (v_idx)""",
)
def ld_cross_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The samples' two halves as two panels."""
    from lociframe.operators import ld_reference

    g, v = views.geno(spark, sf), views.variants(spark, sf)
    parts = [ld.pair_correlations(g.where(F.col("s_idx") % 2 == k), v, SCORE_WINDOW) for k in range(2)]
    return ld_reference.cross_scores(*parts, v).select("v_idx", r("cross_score", 5))


@register(
    "grm_sparse",
    GRM.format(where="") + "SELECT * FROM (SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 6) AS k FROM e a JOIN e b USING (v_idx), norm WHERE a.s_idx <= b.s_idx GROUP BY 1, 2) WHERE i = j OR abs(k) >= 0.1",
)
def grm_sparse(spark: SparkSession, sf: str) -> DataFrame:
    # what rounds to the threshold is still to come
    rows = kinship.sparse_pairs(kinship.encoded(views.geno(spark, sf)), 0.1 - 1e-6, sample_ids(spark, sf), variants=views.variants(spark, sf).count()).withColumn("k", F.round("k", 6))
    return rows.where("i = j OR abs(k) >= 0.1")


@register("lmm_scan_sparse")
def lmm_scan_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships above a threshold only, exact within the families they make."""
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    pairs = kinship.sparse_pairs(kinship.encoded(views.geno(spark, sf)), 0.15, t["s_idx"].tolist(), variants=views.variants(spark, sf).count())
    fit = mixed.fit_sparse(t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), pairs, t["s_idx"].tolist())
    return mixed.scan(views.geno(spark, sf), fit)


@register("max_t_adaptive")
def max_t_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    return hypotheses.adaptive_max(views.geno(spark, sf), t["s_idx"].tolist(), t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), 50, 200)


@register("adaptive_thresholds")
def adaptive_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return hypotheses.adaptive_thresholds(views.pvals(spark, sf), "n", ["v_idx"], q=0.5).select("v_idx", "p", "threshold", "selected")


@register("masked_thresholds")
def masked_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return hypotheses.masked_thresholds(views.pvals(spark, sf), "n").select("v_idx", "p", F.round("threshold", 9).alias("threshold"), "selected")


@register(
    "scan_agreement",
    cte("studies") + """, p AS (SELECT study, v_idx, -log10(greatest(exp(-power(beta / se, 2) / 2), 1e-300)) AS l FROM studies), b AS (SELECT a.l AS a, b.l AS b FROM p a JOIN p b USING (v_idx) WHERE a.study = 'N' AND b.study = 'R')
    SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, round(max(abs(a - b)), 6) AS max_gap, round(avg(abs(a - b)), 6) AS mean_gap, round(avg((abs(a - b) <= 0.1)::INT), 6) AS share_within FROM b""",
)
def scan_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.studies(spark, sf).withColumn("p", F.exp(-F.pow(F.col("beta") / F.col("se"), 2) / 2))
    found = hypotheses.compare_p(rows.where("study = 'N'"), rows.where("study = 'R'"), tolerance=0.1)
    return found.select("n", *(r(c) for c in ("correlation", "max_gap", "mean_gap", "share_within")))


@register(
    "conditional_evidence",
    cte("pvals") + """, x AS (SELECT v_idx, p AS p_gwas, power(p, 0.3) AS p_twas, least(p * (1 + v_idx % 20), 1) AS p_conditional FROM pvals),
    m AS (SELECT *, log10(greatest(p_conditional, 1e-300)) - log10(greatest(p_gwas, 1e-300)) >= 1 AS mediated FROM x)
    SELECT v_idx, mediated, round(CASE WHEN mediated THEN p_twas ELSE 0.5 - atan((tan((0.5 - p_gwas) * pi()) + tan((0.5 - p_twas) * pi())) / 2) / pi() END, 6) AS p_combined FROM m""",
)
def conditional_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pvals(spark, sf).select("v_idx", F.col("p").alias("p_gwas"), F.pow("p", F.lit(0.3)).alias("p_twas"), F.least(F.col("p") * (1 + F.col("v_idx") % 20), F.lit(1.0)).alias("p_conditional"))
    return hypotheses.conditional_evidence(rows).select("v_idx", "mediated", r("p_combined"))


@register(
    "normal_scores",
    cte("samples") + f""", q AS (SELECT s_idx, family, (rank() OVER (PARTITION BY family ORDER BY y) + (count(*) OVER (PARTITION BY family, y) - 1) / 2 - 0.375) / (count(*) OVER (PARTITION BY family) + 0.25) AS q FROM samples)
    SELECT s_idx, family, round({norm_ppf('q')}, 6) + 0::DOUBLE AS score FROM q""",
)
def normal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return views.samples(spark, sf).select("s_idx", "family", (F.round(hypotheses.normal_scores("y", ["family"]), 6) + F.lit(0.0)).alias("score"))


@register(
    "qc_long",
    STATS + """SELECT v_idx, statistic, round(value, 6) + 0::DOUBLE AS value FROM (SELECT v_idx, af, maf, miss_rate, het FROM stats) UNPIVOT (value FOR statistic IN (af, maf, miss_rate, het))""",
)
def qc_long(spark: SparkSession, sf: str) -> DataFrame:
    names = ["af", "maf", "miss_rate", "het"]
    return stats(spark, sf).unpivot(["v_idx"], names, "statistic", "value").select("v_idx", "statistic", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@register(
    "variant_sets",
    cte("geno") + """, hom AS (SELECT v_idx FROM geno WHERE dosage = 2 AND s_idx % 3 = 0), het AS (SELECT v_idx FROM geno WHERE dosage = 1 AND s_idx % 3 = 1)
    SELECT v_idx, 'both' AS kind FROM (SELECT v_idx FROM hom INTERSECT SELECT v_idx FROM het) UNION ALL SELECT v_idx, 'only_first' FROM (SELECT v_idx FROM hom EXCEPT SELECT v_idx FROM het)""",
)
def variant_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = views.geno(spark, sf)
    hom, het = g.where("dosage = 2 AND s_idx % 3 = 0").select("v_idx"), g.where("dosage = 1 AND s_idx % 3 = 1").select("v_idx")
    return hom.intersect(het).withColumn("kind", F.lit("both")).unionByName(hom.subtract(het).withColumn("kind", F.lit("only_first")))


@register("haplotype_scan")
def haplotype_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Score and kernel tests of the haplotypes of each gene's region under a mixed model."""
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    fit = mixed.fit_null(t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), thin.relationship(views.geno(spark, sf), t["s_idx"].tolist()), t["s_idx"].tolist())
    return haplotypes.scan(*_haplotypes(spark, sf), fit)


@register("haplotype_interaction")
def haplotype_interaction(spark: SparkSession, sf: str) -> DataFrame:
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    return haplotypes.scan_interaction(*_haplotypes(spark, sf), t["s_idx"].tolist(), t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), t["cov"].to_numpy(float))


def _haplotypes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = views.geno(spark, sf)
    first = g.select("v_idx", "s_idx", F.lit(0).alias("copy"), (F.col("dosage") >= 1).cast("int").alias("allele"))
    calls = first.unionByName(g.select("v_idx", "s_idx", F.lit(1).alias("copy"), (F.col("dosage") == 2).cast("int").alias("allele")))
    hit = intervals.range_join(views.variants(spark, sf), views.genes(spark, sf), "start", "end").select(F.col("gene").alias("region"), "v_idx")
    return calls, hit
