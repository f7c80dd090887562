"""Queries: scans of binary, ordinal, categorical, survival, interaction and joint traits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import env_glmm, glm, glmm, multitrait, thin
from lociframe.operators.packed import map_variants

from . import views
from .catalogue import register
from .core import CELLS, cells, r
from .tails import chi2_sf, f_sf


def table(spark: SparkSession, sf: str) -> pd.DataFrame:
    """Samples by id, with a few traits made of the account balance."""
    rows = views.samples(spark, sf).orderBy("s_idx").toPandas()
    rows["level"] = np.floor((rows["y"] + 1) / 4).clip(0, 2).astype(int)
    rows["group"] = rows["s_idx"] % 3
    rows["time"] = rows["y"] + 2
    return rows


#: Mean-imputed calls of every sample, with a design of 1 and cov, and what remains of a column after them.
GRID = CELLS + """, x AS (SELECT v_idx, s_idx, coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)) AS g, y, cov, sin(s_idx * 1.7) AS y2, (s_idx % 3) AS grp, status FROM cells JOIN samples USING (s_idx)) """


def _left(column: str, name: str) -> str:
    own = "OVER (PARTITION BY v_idx)"
    return f"{column} - avg({column}) {own} - (cov - avg(cov) {own}) * covar_pop({column}, cov) {own} / var_pop(cov) {own} AS {name}"


def _scan(spark: SparkSession, sf: str, t: pd.DataFrame, score, state, schema: str) -> DataFrame:
    return map_variants(views.geno(spark, sf), t["s_idx"].tolist(), score, state, schema)


def _design(t: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), t["cov"]])


@register("logistic_scan")
def logistic_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return _scan(spark, sf, t, glm.score_logistic, glm.fit_logistic(t["status"].to_numpy(float), _design(t)), "beta double, se double, chi2 double, p double")


@register("logistic_scan_firth")
def logistic_scan_firth(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return _scan(spark, sf, t, glm.score_logistic, glm.fit_logistic(t["status"].to_numpy(float), _design(t), firth=True), "beta double, se double, chi2 double, p double")


@register(
    "logistic_score",
    GRID.replace("WITH ", "WITH RECURSIVE ", 1) + """, nr AS (SELECT 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1 UNION ALL SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT k, b0, b1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * cov) AS h01, sum(m * (1 - m) * cov * cov) AS h11, sum(status - m) AS g0, sum((status - m) * cov) AS g1
        FROM (SELECT k, b0, b1, status, cov, 1 / (1 + exp(-(b0 + b1 * cov))) AS m FROM nr, samples WHERE k < 25) GROUP BY k, b0, b1)),
    e AS (SELECT v_idx, g, cov, status - m AS e, m * (1 - m) AS w FROM (SELECT x.*, 1 / (1 + exp(-(b0 + b1 * cov))) AS m FROM x, (SELECT * FROM nr WHERE k = 25))),
    s AS (SELECT v_idx, sum(g * e) AS u, sum(w * g * g) AS gg, sum(w * g) AS g0, sum(w * g * cov) AS g1, sum(w) AS h00, sum(w * cov) AS h01, sum(w * cov * cov) AS h11 FROM e GROUP BY 1),
    v AS (SELECT v_idx, u, gg - (g0 * g0 * h11 - 2 * g0 * g1 * h01 + g1 * g1 * h00) / (h00 * h11 - h01 * h01) AS v FROM s)
    SELECT v_idx, round(u / v, 6) + 0::DOUBLE AS beta, round(1 / sqrt(v), 6) AS se, round(u * u / v, 6) AS chi2 FROM v""",
)
def logistic_score(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    rows = _scan(spark, sf, t, glm.score_logistic, glm.fit_logistic(t["status"].to_numpy(float), _design(t)), "beta double, se double, chi2 double, p double")
    return rows.select("v_idx", (F.round("beta", 6) + F.lit(0.0)).alias("beta"), r("se"), r("chi2"))


def _kinship(spark: SparkSession, sf: str, t: pd.DataFrame) -> np.ndarray | thin.Thin:
    return thin.relationship(views.geno(spark, sf), t["s_idx"].tolist())


for _family, _trait in (("logit", "status"), ("probit", "status"), ("log", "level"), ("identity", "y")):

    def _glmm(spark: SparkSession, sf: str, family: str = _family, trait: str = _trait) -> DataFrame:
        t = table(spark, sf)
        return glmm.scan(views.geno(spark, sf), glmm.fit(t[trait].to_numpy(float), _design(t), _kinship(spark, sf, t), t["s_idx"].tolist(), family))

    register(f"glmm_{_family}")(_glmm)


@register("glmm_ordinal")
def glmm_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return glmm.scan(views.geno(spark, sf), glmm.fit_ordinal(t["level"].to_numpy(), t[["cov"]].to_numpy(float), _kinship(spark, sf, t), t["s_idx"].tolist()))


@register("glmm_multinomial")
def glmm_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return glmm.scan_multinomial(views.geno(spark, sf), glmm.fit_multinomial(t["group"].to_numpy(), _design(t), _kinship(spark, sf, t), t["s_idx"].tolist()))


@register("glmm_survival")
def glmm_survival(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return glmm.scan(views.geno(spark, sf), glmm.fit_survival(t["time"].to_numpy(float), t["status"].to_numpy(float), t[["cov"]].to_numpy(float), _kinship(spark, sf, t), t["s_idx"].tolist()))


def _traits(t: pd.DataFrame) -> np.ndarray:
    return np.column_stack([t["y"], np.sin(t["s_idx"] * 1.7)])


@register("multi_trait_lmm")
def multi_trait_lmm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return multitrait.scan(views.geno(spark, sf), multitrait.fit(_traits(t), _design(t), _kinship(spark, sf, t), t["s_idx"].tolist()))


for _structure in ("unstructured", "diagonal", "fa1"):

    def _environments(spark: SparkSession, sf: str, structure: str = _structure) -> DataFrame:
        t = table(spark, sf)
        y = np.column_stack([t["y"], 0.5 * t["y"] + np.sin(t["s_idx"] * 1.7), np.cos(t["s_idx"] * 0.9)])
        return multitrait.scan_environments(views.geno(spark, sf), multitrait.fit(y, _design(t), _kinship(spark, sf, t), t["s_idx"].tolist(), structure))

    register(f"multi_env_{_structure}")(_environments)


@register("multi_trait_multi_env")
def multi_trait_multi_env(spark: SparkSession, sf: str) -> DataFrame:
    """Two traits in two environments, the genetic covariance a product of one for each."""
    t = table(spark, sf)
    y = np.column_stack([t["y"], t["y"] + np.sin(t["s_idx"] * 2.3), np.sin(t["s_idx"] * 1.7), np.cos(t["s_idx"] * 0.9)])
    return multitrait.scan(views.geno(spark, sf), multitrait.fit(y, _design(t), _kinship(spark, sf, t), t["s_idx"].tolist(), "separable", (2, 2)))


@register("random_regression")
def random_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients on time of four measures of each sample, as traits."""
    t = table(spark, sf)
    times = np.array([0.0, 1.0, 2.0, 4.0])
    y = t["y"].to_numpy()[:, None] + np.sin(np.outer(t["s_idx"], times + 1)) + times[None] * (t["cov"].to_numpy()[:, None] - 3) / 10
    return multitrait.scan(views.geno(spark, sf), multitrait.fit(multitrait.random_regression(y, times, 1), _design(t), _kinship(spark, sf, t), t["s_idx"].tolist()))


@register("multi_kernel_lmm")
def multi_kernel_lmm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    ids, c = t["s_idx"].tolist(), cells(spark, sf)
    additive, dominance = thin.relationship(c, ids), thin.relationship(c, ids, "dominance")
    return multitrait.scan_kernels(c, multitrait.fit_kernels(t["y"].to_numpy(float), _design(t), [additive, dominance], ids))


@register("heteroscedastic_lmm")
def heteroscedastic_lmm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return multitrait.scan_kernels(views.geno(spark, sf), multitrait.fit_heteroscedastic(t["y"].to_numpy(float), _design(t), _kinship(spark, sf, t), t["group"].to_numpy(), t["s_idx"].tolist()))


@register("gxe_lmm")
def gxe_lmm(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    z = t["cov"].to_numpy(float)
    fit = multitrait.fit_kernels(t["y"].to_numpy(float), _design(t), multitrait.interaction_kernels(_kinship(spark, sf, t), z - z.mean()), t["s_idx"].tolist())
    return multitrait.scan_gxe(views.geno(spark, sf), fit, z)


#: Ordered flags of each sample's lines: the environments of a binary trait.
FLAGS = ("A", "N", "R")


def environments(spark: SparkSession, sf: str) -> pd.DataFrame:
    """Per sample: cov, and for each return flag its lines' mean quantity (null where it has none)."""
    lines = views.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_idx")).pivot("l_returnflag", list(FLAGS)).agg(F.avg("l_quantity"))
    return views.samples(spark, sf).select("s_idx", "cov").join(lines, "s_idx", "left").orderBy("s_idx").toPandas()


def _above(t: pd.DataFrame, *cuts: float) -> np.ndarray:
    """How many of the cuts each environment's value lies above; nan where unseen."""
    values = t[list(FLAGS)].to_numpy(float)
    return np.where(np.isnan(values), np.nan, sum((values > c).astype(float) for c in cuts))


@register("multi_env_glmm_binary")
def multi_env_glmm_binary(spark: SparkSession, sf: str) -> DataFrame:
    t = environments(spark, sf)
    return env_glmm.scan(views.geno(spark, sf), env_glmm.fit(_above(t, 25.5), _design(t), _kinship(spark, sf, t), t["s_idx"].tolist()))


@register("multi_env_glmm_ordinal")
def multi_env_glmm_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    t = environments(spark, sf)
    return env_glmm.scan(views.geno(spark, sf), env_glmm.fit(_above(t, 25.0, 26.0), t[["cov"]].to_numpy(float), _kinship(spark, sf, t), t["s_idx"].tolist(), "ordinal"))


@register(
    "multi_env_glm_binary",
    CELLS + """, v AS (SELECT l_suppkey AS s_idx, l_returnflag AS env, (avg(l_quantity) > 25.5)::INT AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    m AS (SELECT env, avg(y) AS mu FROM v GROUP BY 1),
    x AS (SELECT v_idx, s_idx, coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)) AS g FROM cells),
    t AS (SELECT v_idx, env, sum(g * (y - mu)) AS u, mu * (1 - mu) * (sum(g * g) - sum(g) * sum(g) / count(*)) AS i FROM x JOIN v USING (s_idx) JOIN m USING (env) GROUP BY v_idx, env, mu),
    a AS (SELECT v_idx, sum(u * u / i) AS joint, sum(u) * sum(u) / sum(i) AS common, sum(u) / sum(i) AS alpha, 1 / sqrt(sum(i)) AS se FROM t GROUP BY 1)
    SELECT v_idx, round(joint, 6) AS chi2, round(alpha, 6) + 0::DOUBLE AS alpha, round(se, 6) AS se, round(joint - common, 6) + 0::DOUBLE AS chi2_gxe FROM a""",
)
def multi_env_glm_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Without covariance between samples and with an intercept only, the score tests have a closed form."""
    t = environments(spark, sf)
    null = env_glmm.fit(_above(t, 25.5), np.ones((len(t), 1)), thin.Thin(np.zeros((len(t), 1))), t["s_idx"].tolist(), sigma=np.zeros((len(FLAGS), len(FLAGS))))
    rows = env_glmm.scan(views.geno(spark, sf), null)
    return rows.select("v_idx", r("chi2"), (F.round("alpha", 6) + F.lit(0.0)).alias("alpha"), r("se"), (F.round("chi2_gxe", 6) + F.lit(0.0)).alias("chi2_gxe"))


@register("ordinal_scan")
def ordinal_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return _scan(spark, sf, t, glm.score_ordinal, glm.fit_ordinal(t["level"].to_numpy(), t[["cov"]].to_numpy(float)), "u double, chi2 double, p double")


@register("multinomial_scan")
def multinomial_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return _scan(spark, sf, t, glm.score_multinomial, glm.fit_multinomial(t["group"].to_numpy(), _design(t)), "chi2 double, p double")


@register("cox_scan")
def cox_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    return _scan(spark, sf, t, glm.score_cox, glm.fit_cox(t["time"].to_numpy(float), t["status"].to_numpy(), t[["cov"]].to_numpy(float)), "beta double, chi2 double, p double")


@register(
    "gxe_scan",
    GRID + f""", l AS (SELECT v_idx, {_left('g', 'a')}, {_left('g * cov', 'b')}, {_left('y', 'r')} FROM x),
    s AS (SELECT v_idx, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * r) AS ay, sum(b * r) AS by_, sum(r * r) AS yy FROM l GROUP BY 1),
    d AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS main, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS inter FROM s WHERE aa * bb - ab * ab > 1e-9),
    f AS (SELECT *, (yy - main * ay - inter * by_) / (n - 4) AS s2 FROM d),
    t AS (SELECT *, main * main * det / bb / s2 AS fm, inter * inter * det / aa / s2 AS fi, (main * ay + inter * by_) / 2 / s2 AS fj, (n - 4)::DOUBLE AS df FROM f)
    SELECT v_idx, round(main, 6) AS beta_main, round(inter, 6) AS beta_interact, round({f_sf('fm', '1::DOUBLE', 'df')}, 6) AS p_main, round({f_sf('fi', '1::DOUBLE', 'df')}, 6) AS p_interact,
      round(fj, 6) AS stat_joint, round({f_sf('fj', '2::DOUBLE', 'df')}, 6) AS p_joint FROM t""",
)
def gxe_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    state = {"y": t["y"].to_numpy(float), "x": _design(t), "z": t["cov"].to_numpy(float)}
    names = ["beta_main", "beta_interact", "p_main", "p_interact", "stat_joint", "p_joint"]
    return _scan(spark, sf, t, glm.score_interaction, state, ", ".join(f"{n} double" for n in names)).where("NOT isnan(beta_main)").select("v_idx", *map(r, names))


@register(
    "multi_trait_scan",
    GRID + f""", l AS (SELECT v_idx, {_left('g', 'a')}, {_left('y', 'r')}, {_left('y2', 'q')} FROM x),
    s AS (SELECT v_idx, sum(a * a) AS aa, sum(a * r) / sum(a * a) AS b0, sum(a * q) / sum(a * a) AS b1, sum(r * r) / (count(*) - 2) AS c00, sum(r * q) / (count(*) - 2) AS c01, sum(q * q) / (count(*) - 2) AS c11 FROM l GROUP BY 1),
    t AS (SELECT *, aa * (b0 * b0 * c11 - 2 * b0 * b1 * c01 + b1 * b1 * c00) / (c00 * c11 - c01 * c01) AS stat FROM s)
    SELECT v_idx, round(stat, 6) AS stat, round({chi2_sf('stat', '2::DOUBLE')}, 6) AS p, round(b0, 6) + 0::DOUBLE AS beta_d0, round(b1, 6) + 0::DOUBLE AS beta_d1 FROM t""",
)
def multi_trait_scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf)
    traits = np.column_stack([t["y"], np.sin(t["s_idx"] * 1.7)])
    return _scan(spark, sf, t, glm.score_multi_trait, {"y": traits, "x": _design(t)}, "stat double, p double, beta_d0 double, beta_d1 double").select(
        "v_idx", r("stat"), r("p"), (F.round("beta_d0", 6) + F.lit(0.0)).alias("beta_d0"), (F.round("beta_d1", 6) + F.lit(0.0)).alias("beta_d1")
    )


@register("permutation_max_t")
def permutation_max_t(spark: SparkSession, sf: str) -> DataFrame:
    """Family-wise p of each variant: blocks give their maxima under shared permutations, which combine by maximum."""
    t = table(spark, sf)
    y, x, n = t["y"].to_numpy(float), _design(t), 200

    def blocks(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        own = glm.permutation_max(g, s["y"], s["x"], n, 11)
        q, _ = np.linalg.qr(s["x"])
        ry, rg = s["y"] - q @ (q.T @ s["y"]), g - q @ (q.T @ g)
        r2 = (rg.T @ ry) ** 2 / np.maximum((rg * rg).sum(axis=0) * (ry @ ry), 1e-300)
        return {"r2": r2, "maxima": [own.tolist()] + [None] * (g.shape[1] - 1)}

    rows = map_variants(views.geno(spark, sf), t["s_idx"].tolist(), blocks, {"y": y, "x": x}, "r2 double, maxima array<double>")
    null = rows.where("maxima IS NOT NULL").select(F.posexplode("maxima").alias("k", "m")).groupBy("k").agg(F.max("m").alias("m")).agg(F.collect_list("m").alias("null"))
    return rows.select("v_idx", "r2").crossJoin(F.broadcast(null)).select("v_idx", "r2", ((1 + F.size(F.filter("null", lambda m: m >= F.col("r2") - 1e-12))) / (n + 1)).alias("p_fwer"))
