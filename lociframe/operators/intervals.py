"""Range joins and interval self-joins as equi-joins on position bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, lo: str, hi: str, closed: bool = False, bin_size: int = 100_000, pos: str = "pos", chrom: str = "chr") -> DataFrame:
    """Points inside [lo, hi), or [lo, hi] if closed, of ranges on the same chromosome.

    Each range is listed under the bins it touches, so points meet ranges by (chr, bin): no
    nested loop, and a range costs as many rows as it has bins.
    """
    last = F.col(hi) if closed else F.greatest(F.col(hi) - 1, F.col(lo))
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(last / bin_size)))).withColumnRenamed(chrom, "__chr")
    upper = F.col(pos) <= F.col(hi) if closed else F.col(pos) < F.col(hi)
    hit = points.withColumn("__at", F.floor(F.col(pos) / bin_size)).join(binned, (F.col("__at") == F.col("__bin")) & (F.col(chrom) == F.col("__chr")) & (F.col(pos) >= F.col(lo)) & upper)
    return hit.drop("__at", "__bin", "__chr")


def neighbours(items: DataFrame, window: int, key: str = "v_idx", pos: str = "pos", chrom: str = "chr") -> DataFrame:
    """(chr, i, j, pos_i, pos_j) with pos_i < pos_j <= pos_i + window on one chromosome."""
    left = items.select(F.col(chrom).alias("chr"), F.col(key).alias("i"), F.col(pos).alias("pos_i"), F.floor(F.col(pos) / window).alias("bin"))
    right = items.select(F.col(chrom).alias("chr"), F.col(key).alias("j"), F.col(pos).alias("pos_j"), F.floor(F.col(pos) / window).alias("own"))
    right = right.withColumn("bin", F.explode(F.array(F.col("own"), F.col("own") - 1))).drop("own")
    return left.join(right, ["chr", "bin"]).where((F.col("pos_j") > F.col("pos_i")) & (F.col("pos_j") <= F.col("pos_i") + window)).drop("bin")


def islands(rows: DataFrame, starts: Column, within: list[str], order: list[str], out: str = "island") -> DataFrame:
    """Number the runs of rows: a row where ``starts`` holds begins a new one."""
    own = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(own))
