"""Queries: conditional and multi-locus scans, knockoffs, cross-fitting, haplotypes, repeated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import intervals, longitudinal, multilocus, multiple_testing

from . import views
from .catalogue import register
from .core import r
from .glms import _design, table


def _study(spark: SparkSession, sf: str):
    t = table(spark, sf)
    return views.geno(spark, sf), t["s_idx"].tolist(), t["y"].to_numpy(float), _design(t)


@register("conditional_leads")
def conditional_leads(spark: SparkSession, sf: str) -> DataFrame:
    return multilocus.conditional_leads(*_study(spark, sf), threshold=0.05, most=3)


@register("blink")
def blink(spark: SparkSession, sf: str) -> DataFrame:
    found, chosen = multilocus.blink(*_study(spark, sf), threshold=0.02)
    return found.withColumn("chosen", F.col("v_idx").isin(chosen) if chosen else F.lit(False))


@register("farmcpu")
def farmcpu(spark: SparkSession, sf: str) -> DataFrame:
    c, ids, y, x = _study(spark, sf)
    found, chosen = multilocus.farmcpu(c, views.variants(spark, sf), ids, y, x, threshold=0.02)
    return found.withColumn("chosen", F.col("v_idx").isin(chosen) if chosen else F.lit(False))


@register("knockoff_scan")
def knockoff_scan(spark: SparkSession, sf: str) -> DataFrame:
    c, ids, y, x = _study(spark, sf)
    return multiple_testing.knockoff_filter(multilocus.knockoff_statistics(c, views.variants(spark, sf), ids, y, x), "w", 0.5).select("v_idx", "w", "selected")


@register("cross_fitted_scan")
def cross_fitted_scan(spark: SparkSession, sf: str) -> DataFrame:
    return multilocus.cross_fitted(*_study(spark, sf))


@register("haplotype_gwas")
def haplotype_gwas(spark: SparkSession, sf: str) -> DataFrame:
    _, ids, y, x = _study(spark, sf)
    g = views.geno(spark, sf)
    copies = g.select("v_idx", "s_idx", F.lit(0).alias("copy"), (F.col("dosage") >= 1).cast("int").alias("allele")).unionByName(
        g.select("v_idx", "s_idx", F.lit(1).alias("copy"), (F.col("dosage") == 2).cast("int").alias("allele"))
    )
    hit = intervals.range_join(views.variants(spark, sf), views.genes(spark, sf), "start", "end").select(F.col("gene").alias("region"), "v_idx")
    return multilocus.haplotype_test(copies, hit, ids, y, x)


LONG = "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS sec, value FROM events), b AS (SELECT min(sec)::DOUBLE AS low, max(sec)::DOUBLE AS high FROM e), p AS (SELECT user_id, value, 2 * (sec - low) / greatest(high - low, 1e-12) - 1 AS t FROM e, b) "


@register(
    "longitudinal_lines",
    LONG + """SELECT user_id, count(*) AS n, round(regr_intercept(value, t) * sqrt(2), 4) AS a0, round(regr_slope(value, t) / sqrt(1.5), 4) AS a1 FROM p GROUP BY 1 HAVING count(DISTINCT t) > 1""",
)
def longitudinal_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"), "value")
    return longitudinal.individual_lines(rows, "user_id", "sec", "value").select("user_id", "n", r("a0", 4), r("a1", 4))


@register(
    "longitudinal_curves",
    LONG + """, q AS (SELECT user_id, value AS y, sqrt(0.5) AS p0, sqrt(1.5) * t AS p1, sqrt(2.5) * (3 * t * t - 1) / 2 AS p2, t FROM p),
    g AS (SELECT user_id, count(*) AS n, count(DISTINCT t) AS k, sum(p0 * p0) AS a, sum(p0 * p1) AS b, sum(p0 * p2) AS c, sum(p1 * p1) AS d, sum(p1 * p2) AS e, sum(p2 * p2) AS f, sum(p0 * y) AS u, sum(p1 * y) AS v, sum(p2 * y) AS w FROM q GROUP BY 1),
    x AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g WHERE n > 2 AND k > 2)
    SELECT user_id, round((u * (d * f - e * e) - b * (v * f - w * e) + c * (v * e - w * d)) / det, 3) AS a0, round((a * (v * f - w * e) - u * (b * f - c * e) + c * (b * w - c * v)) / det, 3) AS a1,
      round((a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det, 3) AS a2 FROM x WHERE det > 1e-6""",
)
def longitudinal_curves(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"), "value")
    found = longitudinal.individual_coefficients(rows, "user_id", "sec", "value")
    return found.select("user_id", *(F.round(F.col("coefficients")[k], 3).alias(f"a{k}") for k in range(3)))
