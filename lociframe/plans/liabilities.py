"""Queries: ordered traits beside linear ones. Traits are of suppliers: their balance, and quantities of their lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import liability, thin

from . import views
from .catalogue import register
from .core import r
from .glms import GRID, table
from .tails import chi2_sf, norm_ppf


@register(
    "liability_independent",
    GRID
    + f""", mu AS (SELECT m, exp(-m * m / 2) / sqrt(2 * pi()) AS d, p FROM (SELECT {norm_ppf("p")} AS m, p FROM (SELECT avg(status) AS p FROM samples))),
    e AS (SELECT v_idx, g, y, CASE WHEN status = 1 THEN d / p ELSE -d / (1 - p) END AS s, m FROM x, mu),
    t AS (SELECT v_idx, sum(s * g) AS u, sum(s * (s + m) * g * g) - sum(s * (s + m) * g) * sum(s * (s + m) * g) / sum(s * (s + m)) AS v, covar_pop(g, y) * count(*) AS gy, var_pop(g) * count(*) AS gg FROM e GROUP BY 1),
    s AS (SELECT v_idx, u * u / v AS a, gy * gy / gg / 4 AS b FROM t)
    SELECT v_idx, round(a, 5) AS stat_d0, round(b, 5) AS stat_d1, round(a + b, 5) AS stat, round({chi2_sf("(a + b)", "2::DOUBLE")}, 5) AS p FROM s""",
)
def liability_independent(spark: SparkSession, sf: str) -> DataFrame:
    """A binary and a linear trait at variances that have a closed form: no covariance, residual variances 1 and 4."""
    t = table(spark, sf)
    ids = t["s_idx"].tolist()
    fit = liability.fit(t[["status", "y"]].to_numpy(float), np.ones((len(t), 1)), thin.Thin(np.zeros((len(t), 1))), ids, [0], np.zeros((2, 2)), np.diag([1.0, 4.0]), [np.zeros(1)])
    return liability.scan(views.geno(spark, sf), fit).select("v_idx", r("stat_d0", 5), r("stat_d1", 5), r("stat", 5), r("p", 5))


def _quantities(spark: SparkSession, sf: str, t: pd.DataFrame) -> np.ndarray:
    """Mean quantity of each sample's returned lines; NaN where it has none."""
    lines = views.read(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_idx")).agg(F.avg("l_quantity").alias("q")).toPandas()
    return t.merge(lines, "left", "s_idx")["q"].to_numpy(float)


@register("liability_scan")
def liability_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Balance in three levels and mean returned quantity, with a relationship; covariances from normal scores."""
    t = table(spark, sf)
    ids = t["s_idx"].tolist()
    y = np.column_stack([t["level"].to_numpy(float), _quantities(spark, sf, t)])
    return liability.scan(views.geno(spark, sf), liability.fit(y, np.column_stack([np.ones(len(t)), t["cov"]]), thin.relationship(views.geno(spark, sf), ids), ids, [0]))


@register("liability_scan_two_ordered")
def liability_scan_two_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Two ordered traits and a linear one."""
    t = table(spark, sf)
    ids, q = t["s_idx"].tolist(), _quantities(spark, sf, t)
    y = np.column_stack([t["level"].to_numpy(float), np.where(np.isnan(q), np.nan, (q > 25.5).astype(float)), t["time"]])
    y[:, 2] = np.log(y[:, 2]) + np.sin(t["s_idx"])
    return liability.scan(views.geno(spark, sf), liability.fit(y, np.ones((len(t), 1)), thin.relationship(views.geno(spark, sf), ids), ids, [0, 1]))
