"""Queries: traits over time in several environments. Samples are suppliers, environments return flags, times ship dates, values quantities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import env_curves, thin
from lociframe.operators.env_curves import Basis

from . import views
from .catalogue import register
from .core import r
from .glms import FLAGS, GRID, _left
from .tails import chi2_sf


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, env, day, value): one row for each line."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("double")
    return views.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("env"), day.alias("day"), F.col("l_quantity").alias("value"))


def _projected(spark: SparkSession, sf: str, **options) -> tuple[DataFrame, Basis]:
    rows = measures(spark, sf)
    basis = env_curves.pooled_basis(rows, "day", **options)
    return env_curves.project(rows, basis, "sample", "env", "day", "value"), basis


#: Coefficients of order 1 by sample and environment, on normalised polynomials of pooled time.
LINES = """m AS (SELECT l_suppkey AS sample, l_returnflag AS env, l_quantity AS value, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE AS day FROM lineitem),
  lim AS (SELECT min(day) AS low, max(day) AS high FROM m),
  lines AS (SELECT sample, env, count(*) AS n_obs, regr_intercept(value, 2 * (day - low) / (high - low) - 1) / sqrt(0.5) AS c0, regr_slope(value, 2 * (day - low) / (high - low) - 1) / sqrt(1.5) AS c1
    FROM m, lim WHERE value IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT day) > 1)"""


@register("env_curve_coefficients", f"WITH {LINES} SELECT sample, env, n_obs, round(c0, 5) AS c0, round(c1, 5) AS c1 FROM lines")
def env_curve_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    rows = _projected(spark, sf)[0].where("coefficients is not null")
    return rows.select(F.col("who").alias("sample"), "env", "n_obs", *(F.round(F.col("coefficients")[k], 5).alias(f"c{k}") for k in range(2)))


def _study(spark: SparkSession, sf: str, complete: bool, **options) -> tuple[pd.DataFrame, np.ndarray, Basis, DataFrame]:
    """Samples, their coefficients, the basis, and calls of these samples."""
    t = views.samples(spark, sf).orderBy("s_idx").toPandas()
    projected, basis = _projected(spark, sf, **options)
    y = env_curves.traits(projected, t["s_idx"].tolist(), list(FLAGS), basis.size)
    keep = ~np.isnan(y).any(axis=1) if complete else ~np.isnan(y).all(axis=1)
    t, y = t[keep].reset_index(drop=True), y[keep]
    ids = spark.createDataFrame(t[["s_idx"]])
    return t, y, basis, views.geno(spark, sf).join(F.broadcast(ids), "s_idx", "left_semi")


def _design(t: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), t["cov"]])


COLUMNS = ", ".join(f"max(CASE WHEN env = '{f}' THEN c{k} END) AS y{k}{e}" for k in range(2) for e, f in enumerate(FLAGS))
WHOLE = " AND ".join(f"y{k}{e} IS NOT NULL" for k in range(2) for e in range(3))
#: By variant, coefficient k and environment e: effect b and weight w, one over its variance.
EFFECTS = (
    GRID.replace("FROM cells JOIN samples USING (s_idx)", "FROM cells JOIN samples USING (s_idx) JOIN whole USING (s_idx)").replace("WITH ", f"WITH {LINES}, whole AS (SELECT * FROM (SELECT sample AS s_idx, {COLUMNS} FROM lines GROUP BY 1) WHERE {WHOLE}), ", 1)
    + ", l AS (SELECT v_idx, "
    + _left("g", "g")
    + ", "
    + ", ".join(_left(f"y{k}{e}", f"y{k}{e}") for k in range(2) for e in range(3))
    + " FROM x JOIN whole USING (s_idx)), b AS ("
    + " UNION ALL ".join(
        f"SELECT v_idx, {k} AS k, {e} AS e, sum(g * y{k}{e}) / sum(g * g) AS b, sum(g * g) * (count(*) - 2) / sum(y{k}{e} * y{k}{e}) AS w FROM l GROUP BY 1" for k in range(2) for e in range(3)
    )
    + ")"
)


@register(
    "env_curves_independent",
    EFFECTS
    + f""", c AS (SELECT v_idx, k, sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w) AS q, sum(b) / 3 AS mean, sum(1 / w) / 9 AS var FROM b GROUP BY 1, 2),
    s AS (SELECT v_idx, sum(q) AS gxe, sum(q) FILTER (k = 0) AS gxe0, sum(q) FILTER (k = 1) AS gxe1, sum(mean * mean / var) AS mean FROM c GROUP BY 1),
    a AS (SELECT v_idx, sum(b * b * w) AS stat, sum(b * b * w) FILTER (e = 0) AS e0, sum(b * b * w) FILTER (e = 1 AND k = 0) AS level_e1, sum(b * b * w) FILTER (e = 2 AND k = 1) AS change_e2,
      sum(b) FILTER (e = 2 AND k = 1) AS beta, sum(1 / sqrt(w)) FILTER (e = 2 AND k = 1) AS se FROM b GROUP BY 1)
    SELECT v_idx, round(stat, 6) AS stat_all, round({chi2_sf("stat", "6::DOUBLE")}, 6) AS p_all, round(e0, 6) AS stat_e0, round(level_e1, 6) AS stat_level_e1, round(change_e2, 6) AS stat_change_e2, round(gxe, 6) AS stat_gxe,
      round({chi2_sf("gxe", "4::DOUBLE")}, 6) AS p_gxe, round(gxe0, 6) AS stat_gxe_level, round(gxe1, 6) AS stat_gxe_c1, round(mean, 6) AS stat_mean, round({chi2_sf("mean", "2::DOUBLE")}, 6) AS p_mean, round(beta, 6) + 0::DOUBLE AS beta_c1_e2, round(se, 6) AS se_c1_e2
    FROM a JOIN s USING (v_idx)""",
)
def env_curves_independent(spark: SparkSession, sf: str) -> DataFrame:
    """Every test at a covariance that has a closed form; samples with curves in all environments."""
    t, y, basis, cells = _study(spark, sf, True)
    found = env_curves.scan(cells, env_curves.independent(y, _design(t), t["s_idx"].tolist(), list(FLAGS), basis))
    told = [r(c) for c in ("stat_all", "p_all", "stat_e0", "stat_level_e1", "stat_change_e2", "stat_gxe", "p_gxe", "stat_gxe_level", "stat_gxe_c1", "stat_mean", "p_mean", "se_c1_e2")]
    return found.select("v_idx", *told, (F.round("beta_c1_e2", 6) + F.lit(0.0)).alias("beta_c1_e2"))


@register("env_curves_scan")
def env_curves_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A separable genetic covariance of lines in three environments; effects at both ends of time."""
    t, y, basis, cells = _study(spark, sf, True)
    fit = env_curves.fit(y, _design(t), [thin.relationship(cells, t["s_idx"].tolist())], t["s_idx"].tolist(), list(FLAGS), basis)
    return env_curves.scan(cells, fit, (basis.low, basis.high))


@register("env_curves_kernels")
def env_curves_kernels(spark: SparkSession, sf: str) -> DataFrame:
    """An additive and a dominance kernel, each with a separable covariance; a sample may lack environments."""
    t, y, basis, cells = _study(spark, sf, False)
    ids = t["s_idx"].tolist()
    fit = env_curves.fit(y, _design(t), [thin.relationship(cells, ids, k) for k in ("vanraden", "dominance")], ids, list(FLAGS), basis)
    return env_curves.scan(cells, fit)
