"""Queries: p-values, kinship, mixed models, set tests, fine-mapping, polygenic weights, mediation, streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions import specfun
from lociframe.operators import bayes, encode, intervals, kinship, ld, ld_cuts, matrix_free, mediation, mixed, scan, sumstats, thin
from lociframe.streaming import running

from . import views
from .catalogue import register
from .core import CELLS, JOINED, LINEAR, STATS, cells, joined, r, stats
from .post import BOTH, PAIR_WINDOW, PAIRS, SCORE_PAIRS, SCORE_WINDOW, pairs
from .tails import chi2_sf, norm_cdf, norm_ppf, t_sf2
from .views import cte


@register("hwe_p", STATS + f"SELECT v_idx, round(hwe_chi2, 6) AS hwe_chi2, round(CASE WHEN n_obs < 10 THEN 1 ELSE {chi2_sf('hwe_chi2', '1::DOUBLE')} END, 8) AS hwe_p FROM stats")
def hwe_p(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats(spark, sf)
    p = F.when(F.col("n_obs") < 10, 1.0).otherwise(specfun.chi2_sf_udf(F.col("hwe_chi2"), F.lit(1.0)))
    return rows.select("v_idx", r("hwe_chi2"), F.round(p, 8).alias("hwe_p"))


@register("glm_scan_p", JOINED + LINEAR + f"SELECT v_idx, round(beta, 6) AS beta, round(se, 6) AS se, round({t_sf2('beta / se', '(n - 2)::DOUBLE')}, 8) AS p FROM lin")
def glm_scan_p(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.linear(joined(spark, sf))
    return rows.select("v_idx", r("beta"), r("se"), F.round(specfun.t_sf2_udf(F.col("stat"), (F.col("n") - 2).cast("double")), 8).alias("p"))


@register(
    "rank_int",
    f"""WITH x AS (SELECT vec_id, k - 1 AS feature, embedding[k] AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
    q AS (SELECT vec_id, feature, (rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 - 0.375) / (count(*) OVER (PARTITION BY feature) + 0.25) AS q FROM x)
    SELECT vec_id, feature::INT AS feature, round({norm_ppf('q')}, 6) + 0::DOUBLE AS normal FROM q""",
)
def rank_int(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v"))
    rank, n = encode.average_rank("v", ["feature"]), F.count("*").over(Window.partitionBy("feature"))
    return rows.withColumn("q", (rank - 0.375) / (n + 0.25)).select("vec_id", "feature", (F.round(specfun.norm_ppf_udf("q"), 6) + F.lit(0.0)).alias("normal"))


@register(
    "power",
    cte("pvals", "geno") + f""", f AS (SELECT v_idx, avg(dosage) / 2 AS af FROM geno GROUP BY 1), x AS (SELECT v_idx, 2 * n * af * (1 - af) * beta * beta AS ncp FROM pvals JOIN f USING (v_idx))
    SELECT v_idx, round(ncp, 6) AS ncp, round({norm_cdf('sqrt(ncp) - 1.959963984540054')} + {norm_cdf('-sqrt(ncp) - 1.959963984540054')}, 6) AS power FROM x""",
)
def power(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators import qc

    rows = sumstats.power_ncp(views.pvals(spark, sf).join(qc.allele_frequency(views.geno(spark, sf)), "v_idx"))
    z = F.lit(float(specfun.norm_ppf(1 - 0.05 / 2)[0]))
    root = F.sqrt("ncp")
    return rows.select("v_idx", r("ncp"), F.round(specfun.norm_cdf_udf(root - z) + specfun.norm_cdf_udf(-root - z), 6).alias("power"))


def sample_ids(spark: SparkSession, sf: str) -> list[int]:
    return [x["s_idx"] for x in views.samples(spark, sf).select("s_idx").orderBy("s_idx").collect()]


GRM = CELLS + """, d AS (SELECT v_idx, s_idx, coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)) AS d FROM cells),
  e AS (SELECT v_idx, s_idx, d - avg(d) OVER (PARTITION BY v_idx) AS x, avg(d) OVER (PARTITION BY v_idx) / 2 AS p FROM d),
  norm AS (SELECT sum(2 * p * (1 - p)) AS c FROM (SELECT v_idx, max(p) AS p FROM e {where} GROUP BY 1)) """


@register(
    "grm_vanraden",
    GRM.format(where="") + "SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 6) AS k FROM e a JOIN e b USING (v_idx), norm WHERE a.s_idx <= b.s_idx GROUP BY 1, 2",
)
def grm_vanraden(spark: SparkSession, sf: str) -> DataFrame:
    return kinship.gram_pairs(kinship.encoded(views.geno(spark, sf)), sample_ids(spark, sf), variants=views.variants(spark, sf).count()).select("i", "j", r("k"))


@register(
    "grm_loco",
    GRM.format(where="WHERE v_idx % 5 <> 2") + "SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 6) AS k FROM e a JOIN e b USING (v_idx), norm WHERE a.v_idx % 5 <> 2 AND a.s_idx <= b.s_idx GROUP BY 1, 2",
)
def grm_loco(spark: SparkSession, sf: str) -> DataFrame:
    return kinship.gram_pairs(kinship.encoded(views.geno(spark, sf).where("v_idx % 5 <> 2")), sample_ids(spark, sf), variants=views.variants(spark, sf).count()).select("i", "j", r("k"))


@register(
    "grm_pairs_table",
    GRM.format(where="") + "SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 6) AS k FROM e a JOIN e b USING (v_idx), norm WHERE a.s_idx <= b.s_idx GROUP BY 1, 2",
)
def grm_pairs_table(spark: SparkSession, sf: str) -> DataFrame:
    return kinship.gram_pairs(kinship.encoded(views.geno(spark, sf)), sample_ids(spark, sf), variants=views.variants(spark, sf).count()).select("i", "j", r("k"))


#: The values and the divisor of each relationship, from the mean-imputed dosage g and the frequency p.
KINDS = {
    "yang": ("(g - 2 * p) / sqrt(2 * p * (1 - p))", "1", "WHERE p > 0 AND p < 1"),
    "dominance": ("CASE round(g) WHEN 0 THEN -2 * p * p WHEN 1 THEN 2 * p * (1 - p) ELSE -2 * (1 - p) * (1 - p) END", "2 * p * p * (1 - p) * (1 - p)", ""),
    "su": ("CASE round(g) WHEN 1 THEN 1 - 2 * p * (1 - p) ELSE -2 * p * (1 - p) END", "p * (1 - p) * (1 - p * (1 - p))", ""),
    "slater": ("g - 2 * p", "2 * p * (2 - 2 * p)", ""),
    "pseudo_diploid": ("g - 2 * p", "2 * p * (1 - p)", ""),
}


#: Relationships in which a missing call, at the variant's mean, adds nothing.
SPARSE = ("vanraden", "yang", "slater")


def _kind_sql(kind: str) -> str:
    x, norm, where = KINDS[kind]
    filled = "coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx))"
    filled = f"round({filled})" if kind == "pseudo_diploid" else filled
    return CELLS + f""", d AS (SELECT v_idx, s_idx, {filled} AS g FROM cells), f AS (SELECT v_idx, s_idx, g, avg(g) OVER (PARTITION BY v_idx) / 2 AS p FROM d),
      e AS (SELECT v_idx, s_idx, {x} AS x, {norm} AS norm FROM f {where}), c AS (SELECT sum(norm) AS c FROM (SELECT v_idx, max(norm) AS norm FROM e GROUP BY 1))
      SELECT a.s_idx AS i, b.s_idx AS j, round(sum(a.x * b.x) / max(c), 6) + 0::DOUBLE AS k FROM e a JOIN e b USING (v_idx), c WHERE a.s_idx <= b.s_idx GROUP BY 1, 2"""


for _kind in KINDS:
    register(f"grm_{_kind}", _kind_sql(_kind))(
        lambda spark, sf, kind=_kind: kinship.gram_pairs(kinship.encoded(views.geno(spark, sf) if kind in SPARSE else cells(spark, sf), kind), sample_ids(spark, sf), variants=views.variants(spark, sf).count()).select("i", "j", (F.round("k", 6) + F.lit(0.0)).alias("k"))
    )


@register("pca")
def pca(spark: SparkSession, sf: str) -> DataFrame:
    ids = sample_ids(spark, sf)
    values, vectors = thin.spectrum(thin.relationship(views.geno(spark, sf), ids), 4)
    return spark.createDataFrame(pd.DataFrame({"s_idx": ids} | {f"pc{k + 1}": vectors[:, k] * np.sqrt(values[k]) for k in range(4)}))


def null_fit(spark: SparkSession, sf: str, k: np.ndarray | None = None) -> mixed.NullFit:
    ids = sample_ids(spark, sf)
    k = thin.relationship(views.geno(spark, sf), ids) if k is None else k
    rows = views.samples(spark, sf).orderBy("s_idx").toPandas()
    return mixed.fit_null(rows["y"].to_numpy(float), np.column_stack([np.ones(len(rows)), rows["cov"]]), k, ids)


@register("lmm_scan")
def lmm_scan(spark: SparkSession, sf: str) -> DataFrame:
    return mixed.scan(views.geno(spark, sf), null_fit(spark, sf))


@register("lmm_scan_loco")
def lmm_scan_loco(spark: SparkSession, sf: str) -> DataFrame:
    """Each chromosome against the relationship of the others; the products are made once, by chromosome."""
    placed = views.geno(spark, sf).withColumn("chr", F.col("v_idx") % 5)
    left_out = thin.leave_one_out(placed, sample_ids(spark, sf))
    parts = [mixed.scan(placed.where(F.col("chr") == c), null_fit(spark, sf, k)) for c, k in left_out]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register("lmm_scan_refit")
def lmm_scan_refit(spark: SparkSession, sf: str) -> DataFrame:
    """The variance ratio fitted anew with each variant in the model."""
    ids = sample_ids(spark, sf)
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    return mixed.scan_refit(views.geno(spark, sf), t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), thin.relationship(views.geno(spark, sf), ids), ids)


@register("lmm_scan_low_rank")
def lmm_scan_low_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The leading axes of the relationship only, as for samples beyond a driver's eigenvectors."""
    ids = sample_ids(spark, sf)
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    fit = mixed.fit_null(t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), thin.relationship(views.geno(spark, sf), ids), ids, rank=max(1, len(ids) // 2))
    return mixed.scan(views.geno(spark, sf), fit)


KIN = cte("geno", "samples") + """, p AS (SELECT v_idx, avg(dosage) / 2 AS p FROM geno GROUP BY 1),
  x AS (SELECT v_idx, s_idx, dosage - 2 * p AS x FROM geno JOIN p USING (v_idx) JOIN samples USING (s_idx)),
  f AS (SELECT v_idx, sum(x * y) AS fy, sum(x * cov) AS fc FROM x JOIN samples USING (s_idx) GROUP BY 1), n AS (SELECT sum(2 * p * (1 - p)) AS norm FROM p)
  SELECT s_idx, round(sum(x * fy) / any_value(norm), 6) AS k_y, round(sum(x * fc) / any_value(norm), 6) AS k_cov FROM x JOIN f USING (v_idx), n GROUP BY 1"""


def stored(spark: SparkSession, sf: str) -> tuple[matrix_free.Calls, pd.DataFrame]:
    """The calls for repeated passes, and the samples in their order."""
    return matrix_free.stored_calls(views.geno(spark, sf), sample_ids(spark, sf)), views.samples(spark, sf).orderBy("s_idx").toPandas()


@register("kinship_products", KIN)
def kinship_products(spark: SparkSession, sf: str) -> DataFrame:
    """The relationship times the trait and the covariate, without the relationship."""
    calls, t = stored(spark, sf)
    found = matrix_free.times(calls, t[["y", "cov"]].to_numpy(float))
    return spark.createDataFrame(pd.DataFrame({"s_idx": t["s_idx"], "k_y": found[:, 0], "k_cov": found[:, 1]})).select("s_idx", r("k_y"), r("k_cov"))


@register("lmm_scan_matrix_free")
def lmm_scan_matrix_free(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed-model scan for any number of samples: REML and scores by products with the relationship."""
    calls, t = stored(spark, sf)
    fit = matrix_free.fit_null(t["y"].to_numpy(float), np.column_stack([np.ones(len(t)), t["cov"]]), calls, steps=25)
    return matrix_free.scan(calls, fit)


@register("pca_matrix_free")
def pca_matrix_free(spark: SparkSession, sf: str) -> DataFrame:
    """Leading axes by products with the relationship."""
    calls, t = stored(spark, sf)
    values, vectors = matrix_free.leading_axes(calls, 4)
    return spark.createDataFrame(pd.DataFrame({"s_idx": t["s_idx"]} | {f"pc{k + 1}": vectors[:, k] * np.sqrt(values[k]) for k in range(4)}))


@register("variance_components")
def variance_components(spark: SparkSession, sf: str) -> DataFrame:
    f = null_fit(spark, sf)
    return spark.createDataFrame([(f.sigma2_g, f.sigma2_e, f.sigma2_g / (f.sigma2_g + f.sigma2_e), f.log_likelihood)], "sigma2_g double, sigma2_e double, h2 double, log_likelihood double")


@register("set_tests")
def set_tests(spark: SparkSession, sf: str) -> DataFrame:
    """SKAT, burden and SKAT-O of the variants of each gene region."""
    fit = null_fit(spark, sf)
    shared = spark.sparkContext.broadcast(fit)
    hit = intervals.range_join(views.variants(spark, sf), views.genes(spark, sf), "start", "end").select("gene", "v_idx")
    rows = hit.join(encode.impute_mean(cells(spark, sf)), "v_idx")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="s_idx", columns="v_idx", values="dosage").loc[list(shared.value.samples)]
        maf = np.minimum(wide.mean() / 2, 1 - wide.mean() / 2).to_numpy()
        found = mixed.set_tests(shared.value, wide.to_numpy(float), np.clip(1 - maf, 0, 1) ** 48 * 625)
        return pd.DataFrame({"gene": [group["gene"].iloc[0]], "n_variants": [wide.shape[1]]} | {k: [v] for k, v in found.items()})

    return rows.groupBy("gene").applyInPandas(run, "gene string, n_variants long, q_skat double, p_skat double, p_burden double, p_skato double")


def chromosome_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics with a whole chromosome as a block."""
    return views.pvals(spark, sf).select("v_idx", F.col("chr").alias("block"), (F.col("beta") / F.col("se")).alias("z"), F.col("n").cast("double").alias("n"))


def block_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics in LD blocks of the variants' least LD."""
    return in_blocks(spark, sf, views.pvals(spark, sf))


#: Variants of a block, least and most: a chromosome of the test views has 40.
BLOCK = (8, 24)


def in_blocks(spark: SparkSession, sf: str, stats: DataFrame) -> DataFrame:
    cut = ld_cuts.blocks(views.variants(spark, sf), pairs(spark, sf, PAIR_WINDOW), *BLOCK).select("v_idx", "block")
    return stats.join(cut, "v_idx").select("v_idx", "block", (F.col("beta") / F.col("se")).alias("z"), F.col("n").cast("double").alias("n"))


BOTH_ENDS = PAIRS + """, o AS (SELECT chr, v_idx, row_number() OVER (PARTITION BY chr ORDER BY pos, v_idx) AS place FROM variants),
  e AS (SELECT a.chr, a.place AS lo, b.place AS hi, r * r AS r2 FROM pairs JOIN o a ON a.v_idx = i JOIN o b ON b.v_idx = j) """

CUTS = BOTH_ENDS + """SELECT chr, v_idx, place, round(coalesce((SELECT sum(r2) FROM e WHERE e.chr = o.chr AND e.lo <= o.place AND e.hi > o.place), 0), 6) + 0.0 AS cost FROM o"""


@register("ld_cut_costs", CUTS)
def ld_cut_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The LD that a cut after each variant would cross."""
    return ld_cuts.cut_costs(views.variants(spark, sf), pairs(spark, sf, PAIR_WINDOW)).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


#: The least total over all ways to cut, by one more variant in each step; best(k) has the totals of the cuts after the first k variants.
CUT_TOTALS = BOTH_ENDS.replace("WITH ", "WITH RECURSIVE ", 1) + """, cc AS (SELECT o.chr, place, coalesce(sum(r2), 0) AS cost FROM o LEFT JOIN e ON e.chr = o.chr AND lo <= place AND hi > place GROUP BY 1, 2),
  m AS (SELECT chr, list(cost ORDER BY place) AS cost, count(*) AS n FROM cc GROUP BY 1),
  d AS (SELECT chr, 0 AS k, [0.0::DOUBLE] AS best FROM m
    UNION ALL SELECT d.chr, k + 1, list_append(best, coalesce(list_min(best[greatest(k + 2 - {most}, 1):greatest(k + 2 - {least}, 0)]), 'inf'::DOUBLE) + cost[k + 1]) FROM d JOIN m USING (chr) WHERE k < n)
  SELECT chr, round(list_min(best[greatest(n + 1 - {most}, 1):n]), 5) + 0.0 AS total FROM d JOIN m USING (chr) WHERE k = n""".format(least=8, most=24)


@register("ld_block_totals", CUT_TOTALS)
def ld_block_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The LD between the blocks that the block methods use, by chromosome."""
    cut = ld_cuts.blocks(views.variants(spark, sf), pairs(spark, sf, PAIR_WINDOW), *BLOCK)
    return cut.join(views.variants(spark, sf), "v_idx").groupBy("chr").agg((F.round(F.sum("cost"), 5) + F.lit(0.0)).alias("total"))


@register("susie_rss")
def susie_rss(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.finemap(block_stats(spark, sf), pairs(spark, sf, PAIR_WINDOW))


for _method in ("inf", "grid", "auto", "cs"):
    register({"inf": "ldpred2_inf", "grid": "ldpred2_grid", "auto": "ldpred2_auto", "cs": "prs_cs"}[_method])(
        lambda spark, sf, method=_method: bayes.polygenic_weights(block_stats(spark, sf), pairs(spark, sf, PAIR_WINDOW), method)
    )


@register("hess_covariance")
def hess_covariance(spark: SparkSession, sf: str) -> DataFrame:
    other = in_blocks(spark, sf, views.studies(spark, sf).where("study = 'R'"))
    return bayes.hess_covariance(block_stats(spark, sf), other, pairs(spark, sf, PAIR_WINDOW))


@register("hess")
def hess(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.hess(block_stats(spark, sf), pairs(spark, sf, PAIR_WINDOW))


LDSC = SCORE_PAIRS + BOTH + f""", studies AS ({views.SQL["studies"]}), p AS (SELECT v_idx, n, (beta / se) ** 2 AS chi2 FROM studies WHERE study = 'N'),
  l AS (SELECT v_idx, 1 + coalesce(sum(r2), 0) AS l FROM variants LEFT JOIN both_ways USING (v_idx) GROUP BY 1),
  x AS (SELECT v_idx, chi2, n, l, l * n / avg(n) OVER () AS x, avg(n) OVER () AS nbar, greatest(200 * (avg(chi2) OVER () - 1) / avg(l * n) OVER (), 0) AS h0,
    least(floor((row_number() OVER (ORDER BY v_idx) - 1) / (count(*) OVER () / 20)), 19) AS block FROM p JOIN l USING (v_idx)),
  w1 AS (SELECT *, 1 / (2 * (1 + h0 * n * greatest(l, 1) / 200) ** 2) / greatest(l, 1) AS w FROM x),
  s1 AS (SELECT sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * chi2) AS sy, sum(w * x * chi2) AS sxy, max(nbar) AS nbar FROM w1),
  f1 AS (SELECT (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx) AS a, greatest((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) * 200 / nbar, 0) AS h FROM s1),
  w2 AS (SELECT x.*, 1 / (2 * (a + h * n * greatest(l, 1) / 200) ** 2) / greatest(l, 1) AS w FROM x, f1),
  b AS (SELECT block, sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * chi2) AS sy, sum(w * x * chi2) AS sxy, max(nbar) AS nbar FROM w2 GROUP BY 1),
  t AS (SELECT sum(s0) AS t0, sum(sx) AS tx, sum(sxx) AS txx, sum(sy) AS ty, sum(sxy) AS txy, count(*) AS k FROM b),
  v AS (SELECT k, nbar, (txx * ty - tx * txy) / (t0 * txx - tx * tx) AS a, (t0 * txy - tx * ty) / (t0 * txx - tx * tx) AS s,
    ((txx - sxx) * (ty - sy) - (tx - sx) * (txy - sxy)) / ((t0 - s0) * (txx - sxx) - (tx - sx) ** 2) AS la, ((t0 - s0) * (txy - sxy) - (tx - sx) * (ty - sy)) / ((t0 - s0) * (txx - sxx) - (tx - sx) ** 2) AS ls FROM b, t)
  SELECT round(max(s) * 200 / max(nbar), 5) AS h2, round(sqrt(var_samp(k * s - (k - 1) * ls) / max(k)) * 200 / max(nbar), 5) AS h2_se, round(max(a), 5) AS intercept, round(sqrt(var_samp(k * a - (k - 1) * la) / max(k)), 5) AS intercept_se FROM v"""


@register("ldsc_h2", LDSC)
def ldsc_h2(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pvals(spark, sf).withColumn("chi2", F.pow(F.col("beta") / F.col("se"), 2)).join(ld.scores(pairs(spark, sf, SCORE_WINDOW), views.variants(spark, sf)), "v_idx")
    return bayes.ldsc(rows.select(F.col("v_idx").alias("at"), "chi2", "ld_score", "n"), 200, 20).select(*(r(c, 5) for c in ("h2", "h2_se", "intercept", "intercept_se")))


MED = """WITH j AS (SELECT l_partkey % 200 AS v_idx, l_discount * 100 AS x, l_quantity AS m, l_extendedprice / 1000 AS y FROM lineitem),
  s AS (SELECT v_idx, count(*) AS n, covar_pop(x, x) * count(*) AS xx, covar_pop(m, m) * count(*) AS mm, covar_pop(y, y) * count(*) AS yy, covar_pop(x, m) * count(*) AS xm, covar_pop(x, y) * count(*) AS xy,
    covar_pop(m, y) * count(*) AS my FROM j GROUP BY 1),
  d AS (SELECT *, xx * mm - xm * xm AS det, xm / xx AS a, (xx * my - xm * xy) / (xx * mm - xm * xm) AS b, (mm * xy - xm * my) / (xx * mm - xm * xm) AS direct FROM s WHERE n > 4 AND xx > 1e-9 AND xx * mm - xm * xm > 1e-9)
  SELECT v_idx, n, round(a, 6) AS a, round(b, 6) AS b, round(direct, 6) AS direct, round(a * b, 6) AS indirect,
    round(a * b / sqrt(a * a * ((yy - b * my - direct * xy) / (n - 3) * xx / det) + b * b * ((mm - a * xm) / (n - 2) / xx)), 5) AS z FROM d"""


@register("mediate_sobel", MED)
def mediate_sobel(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "lineitem").select((F.col("l_partkey") % 200).alias("v_idx"), (F.col("l_discount") * 100).alias("x"), F.col("l_quantity").alias("m"), (F.col("l_extendedprice") / 1000).alias("y"))
    return mediation.sobel(rows, ["v_idx"]).select("v_idx", "n", r("a"), r("b"), r("direct"), r("indirect"), r("z", 5))


@register(
    "events_tumbling_counts",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def events_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return running.drained(spark, running.tumbling_counts(running.events(spark, sf)), "complete").withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})


@register("events_sliding_counts", """SELECT window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start FROM events) GROUP BY 1, 2""")
def events_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return running.drained(spark, running.sliding_counts(running.events(spark, sf)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register(
    "events_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS s FROM events),
    k AS (SELECT user_id, ts, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM k GROUP BY user_id, k""",
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = running.drained(spark, running.sessions(running.events(spark, sf)), "complete")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@register(
    "events_running_moments",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance FROM events GROUP BY 1",
)
def events_running_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = running.drained(spark, running.running_moments(running.events(spark, sf)), "complete")
    return rows.select("event_type", "n", r("mean"), r("variance", 5))
