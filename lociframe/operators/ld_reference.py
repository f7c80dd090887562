"""Stored LD of a panel: pairs by block with what says how they were made, and scores across two panels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(ValueError):
    """A stored panel doesn't fit the data it is used with."""


def save(variants: DataFrame, pairs: DataFrame, path: str, **about) -> None:
    """Variants, pairs (partitioned by chromosome) and a line of JSON about them: population, samples, build, window ..."""
    variants.write.mode("overwrite").parquet(f"{path}/variants")
    pairs.repartition("chr").write.mode("overwrite").partitionBy("chr").parquet(f"{path}/pairs")
    told = about | {"n_variants": variants.count()}
    variants.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(variants, pairs, about); only the folders of the chromosomes asked for are read."""
    variants, pairs = spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/pairs")
    if chromosomes is not None:
        variants, pairs = variants.where(F.col("chr").isin(chromosomes)), pairs.where(F.col("chr").isin(chromosomes))
    return variants, pairs, json.loads(spark.read.text(f"{path}/about").first()["value"])


def check(about: dict, wanted: dict) -> None:
    """Raise where a stored panel was made for another population or build, or is smaller than asked for."""
    for key in ("population", "build", "ploidy"):
        if key in wanted and key in about and about[key] != wanted[key]:
            raise Mismatch(f"{key} is {about[key]}, not {wanted[key]}")
    for key in ("n_samples", "window"):
        if key in wanted and key in about and about[key] < wanted[key]:
            raise Mismatch(f"{key} is {about[key]}, less than {wanted[key]}")


def blocks_of(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """(v_idx, block) of variants in blocks (chr, block, start, end); the others are blocks of their own."""
    own = blocks.select(F.col("chr").alias("__c"), F.concat_ws(":", "chr", F.col("block").cast("string")).alias("__b"), "start", "end")
    hit = variants.join(own, (F.col("chr") == F.col("__c")) & F.col("pos").between(F.col("start"), F.col("end")), "left")
    return hit.select("v_idx", F.coalesce("__b", F.concat(F.lit("v"), F.col("v_idx"))).alias("block"))


def cross_scores(first: DataFrame, second: DataFrame, variants: DataFrame) -> DataFrame:
    """(v_idx, cross_score): the sum over near variants of the product of both panels' correlations, itself included."""
    both = first.select("i", "j", F.col("r").alias("r1")).join(second.select("i", "j", F.col("r").alias("r2")), ["i", "j"]).withColumn("x", F.col("r1") * F.col("r2"))
    rows = both.select(F.col("i").alias("v_idx"), "x").unionByName(both.select(F.col("j").alias("v_idx"), "x"))
    sums = rows.groupBy("v_idx").agg(F.sum("x").alias("rest"))
    return variants.select("v_idx").join(sums, "v_idx", "left").select("v_idx", (1 + F.coalesce("rest", F.lit(0.0))).alias("cross_score"))
