"""Queries: quality control, encodings, single-marker scans, corrections and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.operators import combine, encode, multiple_testing, qc, scan

from . import views
from .catalogue import register
from .views import cte


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@register("genotype_view", views.SQL["geno"])
def genotype_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.geno(spark, sf)


@register("variant_meta", views.SQL["variants"])
def variant_meta(spark: SparkSession, sf: str) -> DataFrame:
    return views.variants(spark, sf)


@register("sample_table", "SELECT s_idx, round(y, 6) AS y, family, cov, status FROM (" + views.SQL["samples"] + ")")
def sample_table(spark: SparkSession, sf: str) -> DataFrame:
    return views.samples(spark, sf).withColumn("y", F.round("y", 6))


@register(
    "alignment_manifest",
    cte("geno", "samples")
    + """SELECT s_idx, g.k IS NOT NULL AS in_genotype, p.k IS NOT NULL AS in_phenotype, g.k IS NOT NULL AND p.k IS NOT NULL AS included,
      CASE WHEN p.k IS NULL THEN 'no_phenotype' WHEN g.k IS NULL THEN 'no_genotype' END AS drop_reason
    FROM (SELECT DISTINCT s_idx, 1 AS k FROM geno) g FULL JOIN (SELECT s_idx, 1 AS k FROM samples) p USING (s_idx)""",
)
def alignment_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return qc.alignment_manifest(views.geno(spark, sf), views.samples(spark, sf), "s_idx")


@register("orphan_samples", cte("geno", "samples") + "SELECT s_idx FROM samples WHERE s_idx NOT IN (SELECT s_idx FROM geno WHERE dosage = 2)")
def orphan_samples(spark: SparkSession, sf: str) -> DataFrame:
    return views.samples(spark, sf).select("s_idx").join(views.geno(spark, sf).where("dosage = 2"), "s_idx", "left_anti")


STATS = cte("geno", "samples") + """, s AS (
  SELECT v_idx, count(*) AS n_obs, avg(dosage) / 2 AS af, var_pop(dosage) AS variance, avg((dosage = 1)::INT) AS het,
    count(*) FILTER (dosage = 0) AS c0, count(*) FILTER (dosage = 1) AS c1, count(*) FILTER (dosage = 2) AS c2, (SELECT count(*) FROM samples) AS n_all
  FROM geno GROUP BY 1),
t AS (SELECT *, n_all - n_obs AS n_miss, 1 - n_obs / n_all AS miss_rate, least(af, 1 - af) AS maf, 2 * n_obs * least(af, 1 - af) AS mac,
    least(af, 1 - af) = 0 OR variance < 1e-10 AS mono, 2 * af * (1 - af) AS het_exp FROM s),
stats AS (SELECT *, CASE WHEN het_exp > 1e-10 THEN (het - het_exp) / het_exp ELSE 0 END AS het_excess, greatest(c0, c1, c2) / n_obs AS max_geno_freq,
    power(c0 - n_obs * power(1 - af, 2), 2) / greatest(n_obs * power(1 - af, 2), 0.5) + power(c1 - n_obs * 2 * af * (1 - af), 2) / greatest(n_obs * 2 * af * (1 - af), 0.5)
      + power(c2 - n_obs * power(af, 2), 2) / greatest(n_obs * power(af, 2), 0.5) AS hwe_chi2 FROM t) """


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return qc.variant_stats(views.geno(spark, sf), views.samples(spark, sf))


def _stats_query(name: str, *columns: str) -> None:
    exact = {"v_idx", "n_obs", "n_miss", "mono", "c0", "c1", "c2"}
    # adding 0 turns a rounded -0.0 into 0.0
    told = ", ".join(c if c in exact else f"round({c}, 6) + 0::DOUBLE AS {c}" for c in columns)
    plain = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    register(name, STATS + f"SELECT {told} FROM stats")(lambda spark, sf: stats(spark, sf).select(*(c if c in exact else plain(c) for c in columns)))


_stats_query("allele_freq", "v_idx", "af")
_stats_query("maf_mac", "v_idx", "maf", "mac", "mono")
_stats_query("missingness", "v_idx", "n_obs", "n_miss", "miss_rate")
_stats_query("het_obs_exp", "v_idx", "het", "het_exp", "het_excess")
_stats_query("hwe_chi2", "v_idx", "c0", "c1", "c2", "hwe_chi2")
_stats_query("max_geno_freq", "v_idx", "max_geno_freq")

REASON = """CASE WHEN mono THEN 'MONO' WHEN miss_rate > 0.06 THEN 'MISS' WHEN maf < 0.45 THEN 'MAF' WHEN mac < 60 THEN 'MAC' WHEN max_geno_freq > 0.42 THEN 'GENO_FREQ'
  WHEN n_obs >= 10 AND hwe_chi2 > 14 THEN 'HWE' WHEN het_excess > 0.1 THEN 'HET_EXCESS' END"""
LIMITS = qc.Limits(0.06, 0.45, 60, 0.42, 14, 0.1)


@register("qc_fail_reason", STATS + f"SELECT v_idx, {REASON} AS fail_reason FROM stats")
def qc_fail_reason(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf).select("v_idx", qc.fail_reason(LIMITS).alias("fail_reason"))


@register(
    "qc_by_chr_rollup",
    STATS.replace("WITH ", f"WITH variants AS ({views.SQL['variants']}), ", 1)
    + f"SELECT chr, count(*) AS n, count(*) FILTER ({REASON} IS NULL) AS n_pass, round(avg(maf), 6) AS mean_maf FROM stats JOIN variants USING (v_idx) GROUP BY ROLLUP (chr)",
)
def qc_by_chr_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats(spark, sf).withColumn("reason", qc.fail_reason(LIMITS)).join(views.variants(spark, sf), "v_idx")
    return rows.rollup("chr").agg(F.count("*").alias("n"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_pass"), F.round(F.avg("maf"), 6).alias("mean_maf"))


@register(
    "dosage_class_freq",
    cte("geno") + """SELECT v_idx, dosage::INT AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY v_idx), 6) AS share FROM geno GROUP BY 1, 2""",
)
def dosage_class_freq(spark: SparkSession, sf: str) -> DataFrame:
    return qc.class_frequencies(views.geno(spark, sf)).withColumn("share", F.round("share", 6))


@register("detect_ploidy", cte("geno") + "SELECT CASE WHEN max(round(dosage)) <= 2 THEN 2 WHEN max(round(dosage)) <= 4 THEN 4 ELSE 8 END::INT AS ploidy FROM geno")
def detect_ploidy(spark: SparkSession, sf: str) -> DataFrame:
    return encode.detect_ploidy(views.geno(spark, sf))


CELLS = cte("geno", "variants", "samples") + ", cells AS (SELECT v_idx, s_idx, dosage FROM variants CROSS JOIN samples LEFT JOIN geno USING (v_idx, s_idx)) "


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return encode.dense(views.geno(spark, sf), views.variants(spark, sf), views.samples(spark, sf))


@register("impute_mean", CELLS + "SELECT v_idx, s_idx, round(coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)), 6) AS dosage FROM cells")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    return encode.impute_mean(cells(spark, sf)).withColumn("dosage", F.round("dosage", 6))


@register(
    "impute_mode",
    CELLS + """, modes AS (SELECT v_idx, dosage AS mode FROM (SELECT v_idx, dosage, row_number() OVER (PARTITION BY v_idx ORDER BY count(*) DESC, dosage) AS k
      FROM geno GROUP BY 1, 2) WHERE k = 1) SELECT v_idx, s_idx, coalesce(dosage, mode, 0) AS dosage FROM cells LEFT JOIN modes USING (v_idx)""",
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return encode.impute_mode(cells(spark, sf))


@register(
    "center_scale",
    cte("geno") + """SELECT v_idx, s_idx, round((dosage - avg(dosage) OVER w) / sqrt(greatest(2 * (avg(dosage) OVER w / 2) * (1 - avg(dosage) OVER w / 2), 1e-10)), 6) AS g
      FROM geno WINDOW w AS (PARTITION BY v_idx)""",
)
def center_scale(spark: SparkSession, sf: str) -> DataFrame:
    return encode.scale(views.geno(spark, sf)).select("v_idx", "s_idx", r("g"))


@register(
    "recode_gene_action",
    cte("geno") + """SELECT v_idx, sum((dosage >= 1)::INT)::DOUBLE AS dom1, sum((dosage >= 2)::INT)::DOUBLE AS dom2, sum((dosage = 1)::INT)::DOUBLE AS over, sum(dosage) AS diplo FROM geno GROUP BY 1""",
)
def recode_gene_action(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("dosage")
    names = {"dom1": "1-dom", "dom2": "2-dom", "over": "overdominant", "diplo": "diplo-additive"}
    return views.geno(spark, sf).groupBy("v_idx").agg(*(F.sum(encode.gene_action(d, model)).alias(k) for k, model in names.items()))


PROBS = cte("geno") + """, probs AS (SELECT v_idx, s_idx, k AS class, CASE WHEN k = dosage THEN 0.8 ELSE 0.1 END AS prob FROM geno, (SELECT unnest([0, 1, 2]) AS k)),
  moments AS (SELECT v_idx, s_idx, sum(prob * class) AS expected, sum(prob * class * class) - power(sum(prob * class), 2) AS variance FROM probs GROUP BY 1, 2) """


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.geno(spark, sf).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.withColumn("prob", F.when(F.col("class") == F.col("dosage"), 0.8).otherwise(0.1))


@register("expected_dosage", PROBS + "SELECT v_idx, s_idx, round(expected, 6) AS expected, round(variance, 6) AS variance FROM moments")
def expected_dosage(spark: SparkSession, sf: str) -> DataFrame:
    return encode.dosage_moments(probabilities(spark, sf)).select("v_idx", "s_idx", r("expected"), r("variance"))


@register(
    "dosage_rsq",
    PROBS + """SELECT v_idx, round(least(greatest(1 - avg(variance) / greatest(2 * (avg(expected) / 2) * (1 - avg(expected) / 2), 1e-10), 0), 1), 6) AS rsq FROM moments GROUP BY 1""",
)
def dosage_rsq(spark: SparkSession, sf: str) -> DataFrame:
    return encode.dosage_rsq(encode.dosage_moments(probabilities(spark, sf))).select("v_idx", r("rsq"))


@register(
    "quantile_normalize",
    """WITH x AS (SELECT vec_id, k AS feature, embedding[k] AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
    p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v, vec_id) AS place FROM x), l AS (SELECT place, avg(v) AS level FROM p GROUP BY 1)
    SELECT vec_id, feature::INT AS feature, round(avg(level) OVER (PARTITION BY feature, v), 6) AS normalized FROM p JOIN l USING (place)""",
)
def quantile_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v"))
    rows = rows.withColumn("feature", F.col("feature") + 1)
    return encode.quantile_normalize(rows, "vec_id", "feature", "v").select("vec_id", "feature", r("normalized"))


JOINED = cte("geno", "samples") + ", j AS (SELECT * FROM geno JOIN samples USING (s_idx)) "
LINEAR = """, m AS (SELECT v_idx, count(*) AS n, regr_slope(y, dosage) AS beta, regr_sxx(y, dosage) AS sxx, regr_syy(y, dosage) AS syy, regr_sxy(y, dosage) AS sxy FROM j GROUP BY 1),
 lin AS (SELECT v_idx, n, beta, sqrt((syy - beta * sxy) / (n - 2) / sxx) AS se FROM m WHERE sxx > 0 AND n > 2) """


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return views.geno(spark, sf).join(views.samples(spark, sf), "s_idx")


@register("glm_scan", JOINED + LINEAR + "SELECT v_idx, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS stat FROM lin")
def glm_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.linear(joined(spark, sf)).select("v_idx", "n", r("beta"), r("se"), r("stat"))


@register(
    "glm_scan_covariate",
    JOINED + """, m AS (SELECT v_idx, count(*) AS n, covar_pop(dosage, dosage) * count(*) AS gg, covar_pop(y, y) * count(*) AS yy, covar_pop(cov, cov) * count(*) AS cc,
      covar_pop(dosage, y) * count(*) AS gy, covar_pop(dosage, cov) * count(*) AS gc, covar_pop(y, cov) * count(*) AS yc FROM j GROUP BY 1),
    f AS (SELECT v_idx, n, gg - gc * gc / cc AS a, gy - gc * yc / cc AS b, yy - yc * yc / cc AS s FROM m WHERE n > 3 AND cc > 0)
    SELECT v_idx, n, round(b / a, 6) AS beta, round(sqrt((s - b * b / a) / (n - 3) / a), 6) AS se FROM f WHERE a > 1e-9""",
)
def glm_scan_covariate(spark: SparkSession, sf: str) -> DataFrame:
    return scan.linear_with_covariate(joined(spark, sf)).select("v_idx", "n", r("beta"), r("se"))


@register(
    "score_stat_binary",
    JOINED + """, m AS (SELECT v_idx, count(*) AS n, sum(dosage * status) AS gy, sum(dosage) AS g, avg(status) AS mu, var_pop(dosage) * count(*) AS sxx FROM j GROUP BY 1)
    SELECT v_idx, n, round(gy - mu * g, 6) AS u, round(mu * (1 - mu) * sxx, 6) AS v, round(power(gy - mu * g, 2) / (mu * (1 - mu) * sxx), 6) AS chi2 FROM m WHERE mu * (1 - mu) * sxx > 1e-9""",
)
def score_stat_binary(spark: SparkSession, sf: str) -> DataFrame:
    return scan.logistic_score(joined(spark, sf)).select("v_idx", "n", r("u"), r("v"), r("chi2"))


@register(
    "within_family_scan",
    JOINED + """, c AS (SELECT v_idx, dosage - avg(dosage) OVER w AS g, y - avg(y) OVER w AS r FROM j WINDOW w AS (PARTITION BY v_idx, family))
    SELECT v_idx, count(*) AS n, round(sum(g * r) / sum(g * g), 6) AS beta_within FROM c GROUP BY 1 HAVING sum(g * g) > 1e-9""",
)
def within_family_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.within_family(joined(spark, sf)).select("v_idx", "n", r("beta_within"))


@register("top_hits", cte("pvals") + "SELECT v_idx, snp, chr, pos, round(p, 9) AS p FROM pvals ORDER BY pvals.p, v_idx LIMIT 10")
def top_hits(spark: SparkSession, sf: str) -> DataFrame:
    return scan.top_hits(views.pvals(spark, sf), 10).select("v_idx", "snp", "chr", "pos", r("p", 9))


@register(
    "farmcpu_bins",
    cte("pvals") + """SELECT v_idx, chr, pos, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY chr, pos // 5000 ORDER BY p, v_idx) AS k FROM pvals) b WHERE k = 1
      ORDER BY b.p, v_idx LIMIT 12""",
)
def farmcpu_bins(spark: SparkSession, sf: str) -> DataFrame:
    return scan.top_per_bin(views.pvals(spark, sf), 5000, 12).select("v_idx", "chr", "pos", r("p", 9))


@register(
    "pve_marginal",
    JOINED + LINEAR + """, f AS (SELECT v_idx, avg(dosage) / 2 AS af FROM geno GROUP BY 1),
    e AS (SELECT v_idx, 2 * af * (1 - af) * beta * beta / (SELECT var_samp(y) FROM samples) AS pve FROM lin JOIN f USING (v_idx))
    SELECT v_idx, round(pve / greatest((SELECT sum(pve) FROM e), 1), 6) AS pve FROM e""",
)
def pve_marginal(spark: SparkSession, sf: str) -> DataFrame:
    variance = views.samples(spark, sf).agg(F.var_samp("y").alias("var_y"))
    return scan.variance_explained(scan.linear(joined(spark, sf)), qc.allele_frequency(views.geno(spark, sf)), variance).select("v_idx", r("pve"))


@register(
    "best_model",
    cte("studies") + """, m AS (SELECT v_idx, study AS model, exp(-power(beta / se, 2) / 2) AS p, CASE study WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS k FROM studies),
    s AS (SELECT *, -log10(greatest(p, 1e-300)) - 0.5 * (k - 1) * log10(100.0) AS score FROM m)
    SELECT v_idx, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v_idx ORDER BY score DESC, model) AS place FROM s) WHERE place = 1""",
)
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.studies(spark, sf).withColumn("p", F.exp(-F.pow(F.col("beta") / F.col("se"), 2) / 2)).withColumnRenamed("study", "model")
    rows = rows.withColumn("k", F.when(F.col("model") == "A", 1).when(F.col("model") == "N", 2).otherwise(3))
    return scan.best_model(rows, 100).select("v_idx", "model", r("score"))


def _corrected(name: str, sql: str, make) -> None:
    register(name, cte("pvals") + sql)(lambda spark, sf: make(views.pvals(spark, sf)).select("v_idx", F.round(F.col("p"), 9).alias("p"), F.round("p_adj", 6).alias("p_adj")))


_RANKED = ", k AS (SELECT v_idx, p, row_number() OVER (ORDER BY p, v_idx) AS i, count(*) OVER () AS m FROM pvals) "
_UP = _RANKED + "SELECT v_idx, round(p, 9) AS p, round(min(least(p * m / i * {f}, 1.0)) OVER (ORDER BY i DESC), 6) AS p_adj FROM k"
_corrected("bonferroni", "SELECT v_idx, round(p, 9) AS p, round(least(p * count(*) OVER (), 1.0), 6) AS p_adj FROM pvals", multiple_testing.bonferroni)
_corrected("sidak", "SELECT v_idx, round(p, 9) AS p, round(1 - power(1 - p, count(*) OVER ()), 6) AS p_adj FROM pvals", multiple_testing.sidak)
_corrected("holm", _RANKED + "SELECT v_idx, round(p, 9) AS p, round(max(least(p * (m - i + 1), 1.0)) OVER (ORDER BY i), 6) AS p_adj FROM k", lambda d: multiple_testing.holm(d, ["v_idx"]))
_corrected("bh", _UP.format(f="1"), lambda d: multiple_testing.benjamini_hochberg(d, ["v_idx"]))
_corrected("by", _UP.format(f="(SELECT sum(1.0 / x) FROM range(1, (SELECT count(*) + 1 FROM pvals)) t(x))"), lambda d: multiple_testing.benjamini_yekutieli(d, ["v_idx"]))
_PI0 = "(SELECT least(greatest(count(*) FILTER (p > 0.5) / (count(*) * 0.5), 1 / count(*)), 1.0) FROM pvals)"
_corrected("storey", _UP.format(f=_PI0), lambda d: multiple_testing.storey(d, ["v_idx"], out="p_adj"))
_corrected(
    "weighted_bh",
    """, w AS (SELECT v_idx, p, CASE WHEN v_idx % 4 = 0 THEN 1e6 ELSE least(p / ((v_idx % 4) / avg(v_idx % 4) OVER ()), 1e6) END AS pw FROM pvals),
    k AS (SELECT v_idx, p, pw, row_number() OVER (ORDER BY pw, v_idx) AS i, count(*) OVER () AS m FROM w)
    SELECT v_idx, round(p, 9) AS p, round(min(least(pw * m / i, 1.0)) OVER (ORDER BY i DESC), 6) AS p_adj FROM k""",
    lambda d: multiple_testing.weighted_bh(d.withColumn("w", F.col("v_idx") % 4), "w", ["v_idx"]),
)
_corrected(
    "hierarchical_fdr",
    """, k AS (SELECT v_idx, p, v_idx % 10 AS grp, row_number() OVER (PARTITION BY v_idx % 10 ORDER BY p, v_idx) AS i, count(*) OVER (PARTITION BY v_idx % 10) AS m FROM pvals),
    s AS (SELECT grp, min(p * m / i) AS pg FROM k GROUP BY 1),
    sr AS (SELECT grp, pg, row_number() OVER (ORDER BY pg, grp) AS i, count(*) OVER () AS m FROM s),
    sa AS (SELECT grp, min(least(pg * m / i, 1.0)) OVER (ORDER BY i DESC) AS ga FROM sr),
    x AS (SELECT v_idx, p, grp, min(least(p * m / i, 1.0)) OVER (PARTITION BY grp ORDER BY i DESC) AS pw FROM k)
    SELECT v_idx, round(p, 9) AS p, round(CASE WHEN ga <= 0.5 THEN greatest(ga, pw) ELSE 1.0 END, 6) AS p_adj FROM x JOIN sa USING (grp)""",
    lambda d: multiple_testing.hierarchical(d.withColumn("grp", F.col("v_idx") % 10), "grp", ["v_idx"], q=0.5),
)


@register(
    "knockoff_filter",
    cte("studies") + """, w AS (SELECT v_idx, round(max(abs(beta / se)) FILTER (study = 'N') - max(abs(beta / se)) FILTER (study = 'R'), 6) AS w FROM studies GROUP BY 1),
    t AS (SELECT DISTINCT abs(w) AS t FROM w WHERE w > 0),
    f AS (SELECT t, (1 + (SELECT count(*) FROM w WHERE w <= -t)) / greatest(1, (SELECT count(*) FROM w WHERE w >= t)) AS fdp FROM t)
    SELECT v_idx, w, coalesce(w >= (SELECT min(t) FROM f WHERE fdp <= 0.9), false) AS selected FROM w WHERE w IS NOT NULL""",
)
def knockoff_filter(spark: SparkSession, sf: str) -> DataFrame:
    z = F.abs(F.col("beta") / F.col("se"))
    rows = views.studies(spark, sf).groupBy("v_idx").agg(F.round(F.max(F.when(F.col("study") == "N", z)) - F.max(F.when(F.col("study") == "R", z)), 6).alias("w"))
    return multiple_testing.knockoff_filter(rows.where(F.col("w").isNotNull()), "w", 0.9).select("v_idx", "w", "selected")


ALLP = cte("studies") + ", a AS (SELECT v_idx, study, exp(-power(beta / se, 2) / 2) AS p, n FROM studies) "


def study_p(spark: SparkSession, sf: str) -> DataFrame:
    return views.studies(spark, sf).select("v_idx", "study", "n", F.exp(-F.pow(F.col("beta") / F.col("se"), 2) / 2).alias("p"))


@register(
    "fisher_combined",
    ALLP + """, f AS (SELECT v_idx, -sum(ln(p)) AS h, count(*) AS k FROM a GROUP BY 1)
    SELECT v_idx, k, round(exp(-h) * CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 + h ELSE 1 + h + h * h / 2 END, 6) AS p_fisher FROM f""",
)
def fisher_combined(spark: SparkSession, sf: str) -> DataFrame:
    return combine.fisher(study_p(spark, sf), "v_idx").select("v_idx", "k", r("p_fisher"))


@register("cauchy_combined", ALLP + "SELECT v_idx, round(0.5 - atan(sum(n * tan((0.5 - p) * pi())) / sum(n)) / pi(), 6) AS p_cauchy FROM a GROUP BY 1")
def cauchy_combined(spark: SparkSession, sf: str) -> DataFrame:
    return combine.cauchy(study_p(spark, sf), "v_idx", weight="n").select("v_idx", r("p_cauchy"))


@register("min_p_combined", ALLP + "SELECT v_idx, round(1 - power(1 - min(p), count(*)), 6) AS p_min FROM a GROUP BY 1")
def min_p_combined(spark: SparkSession, sf: str) -> DataFrame:
    return combine.min_p(study_p(spark, sf), "v_idx").select("v_idx", r("p_min"))


@register("harmonic_mean_p", ALLP + "SELECT v_idx, round(least(count(*) / sum(1 / p), 1.0), 6) AS p_harmonic FROM a GROUP BY 1")
def harmonic_mean_p(spark: SparkSession, sf: str) -> DataFrame:
    return combine.harmonic_mean(study_p(spark, sf), "v_idx").select("v_idx", r("p_harmonic"))


@register(
    "truncated_product",
    ALLP + """, t AS (SELECT v_idx, count(*) AS n, sum(ln(p)) FILTER (p <= 0.6) AS lw FROM a GROUP BY 1),
    c AS (SELECT v_idx, n, lw, k, CASE k WHEN 1 THEN n WHEN 2 THEN n * (n - 1) / 2 ELSE n * (n - 1) * (n - 2) / 6 END AS ch, k * ln(0.6) - lw AS gap FROM t, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= n),
    s AS (SELECT v_idx, n, lw, ch * power(0.4, n - k) * CASE WHEN lw <= k * ln(0.6) THEN exp(lw) * CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 + gap ELSE 1 + gap + gap * gap / 2 END ELSE power(0.6, k) END AS x FROM c)
    SELECT v_idx, n, round(CASE WHEN any_value(lw) IS NULL THEN 1 ELSE least(sum(x), 1.0) END, 6) AS p_truncated FROM s GROUP BY 1, 2""",
)
def truncated_product(spark: SparkSession, sf: str) -> DataFrame:
    return combine.truncated_product(study_p(spark, sf), "v_idx", tau=0.6).select("v_idx", "n", r("p_truncated"))


@register(
    "lambda_gc",
    cte("pvals") + "SELECT round(quantile_disc(power(beta / se, 2), 0.5) / 0.4549364231195724, 6) AS lambda FROM pvals",
)
def lambda_gc(spark: SparkSession, sf: str) -> DataFrame:
    return views.pvals(spark, sf).agg(F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY power(beta / se, 2))") / 0.4549364231195724, 6).alias("lambda"))


@register(
    "flagship_scan",
    JOINED + LINEAR + """, p AS (SELECT v_idx, beta, se, exp(-power(beta / se, 2) / 2) AS p FROM lin),
    k AS (SELECT *, row_number() OVER (ORDER BY p, v_idx) AS i, count(*) OVER () AS m FROM p)
    SELECT v_idx, round(beta, 6) AS beta, round(se, 6) AS se, round(p, 9) AS p, round(min(least(p * m / i, 1.0)) OVER (ORDER BY i DESC), 6) AS p_adj FROM k""",
)
def flagship_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Calls to scan to adjusted p, the p-value being the closed-form tail with two degrees of freedom."""
    rows = scan.linear(joined(spark, sf)).withColumn("p", F.exp(-F.pow("stat", 2) / 2))
    rows = multiple_testing.benjamini_hochberg(rows, ["v_idx"])
    return rows.select("v_idx", r("beta"), r("se"), r("p", 9), r("p_adj"))
