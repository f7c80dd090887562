"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into blocks by a hash of key and text (the partitions of the method), and of their
number where they repeat. How many rows
of each block go to each shard is drawn exactly: row b of the matrix is multivariate
hypergeometric over the room still left in the shards. Then each block permutes its rows and
deals them out by its row of the matrix, and each shard permutes what it received. Shard counts
differ by one at most, and every arrangement is equally likely.

Scale: only (key, size, crc, hashes) move, never texts. The matrix has at most MAX_BLOCKS rows
of one count per shard, which bounds what is broadcast. A shard is permuted in sub-blocks whose
places follow from counts, so no task sorts a whole shard. Both windows sort with spilling.

Defined results: a null text has size 16 and the checksum of the empty text; rows that repeat
(key, text) are interchangeable and each gets its own slot; an empty table gives an empty
result; the same rows, seed and shard count give the same places, however they are partitioned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, told_apart, written

BLOCK_ROWS = 10_000
MAX_BLOCKS = 8192


def _stirling(n: int) -> float:
    """log n! less Stirling's formula, to full precision."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without losing digits where they are near."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * k + 1)
            if new == total:
                return total
            total, k = new, k + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """Probability of x of n by Loader's saddle point form: no large logarithms cancel."""
    q = 1 - p
    if x == 0:
        return math.exp(n * math.log1p(-p))
    if x == n:
        return math.exp(n * math.log(p))
    told = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return math.exp(told) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One hypergeometric draw: numpy's up to its limit, else a walk from the mode, whose probability is right to about 1e-13 at any size."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    p = sample / (good + bad)
    at = _binomial(mode, good, p) * _binomial(sample - mode, bad, p) / _binomial(sample, good + bad, p)
    left, down, up, p_down, p_up = rng.random() - at, mode, mode, at, at
    while left > 0:
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if (up >= high or p_up < 1e-300) and (down <= low or p_down < 1e-300):
            break
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Counts from block to shard: a uniform deal of all rows with the given margins."""
    if sum(block_rows) != sum(shard_rows):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng, room, matrix = np.random.default_rng(seed), list(shard_rows), []
    for n in block_rows:
        row, rest = [], sum(room)
        for s, free in enumerate(room):
            rest -= free
            got = _draw(rng, free, rest, n)
            row.append(got)
            n -= got
            room[s] -= got
        matrix.append(row)
    return matrix


def _table(spark: SparkSession, rows: list[list[int]], names: tuple[str, str]) -> DataFrame:
    """A table of (position, array) from a SQL literal."""
    told = ";".join(",".join(map(str, r)) for r in rows)
    cells = spark.range(1).select(F.posexplode(F.split(F.lit(told), ";")))
    return cells.select(F.col("pos").alias(names[0]), F.split("col", ",").cast("array<bigint>").alias(names[1]))


def _before(counts: str) -> Column:
    """How many of the rising counts the row's place lies beyond."""
    return F.size(F.filter(counts, lambda u: u < F.col("place")))


def shuffle_to_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """Per row of ``docs``: key, size (UTF-8 bytes plus 16), text_crc32, shard, slot."""
    spark, value = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(value).cast("long") + 16).alias("size"), F.crc32(value.cast("binary")).alias("crc"), F.xxhash64(F.lit(seed), F.col(key), value).alias("h")
    )
    first = written(rows.withColumn("value", F.col("h")).withColumn("split", F.spark_partition_id()), "shard-first")
    rows = written(told_apart(first, "value").drop("value"), "shard-rows")
    discard(first)
    total = rows.count()
    n_blocks = max(1, min(MAX_BLOCKS, math.ceil(total / BLOCK_ROWS)))
    block = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(n_blocks)).cast("int")
    counts = {r["block"]: r["count"] for r in rows.groupBy(block.alias("block")).count().collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], sizes, seed)
    # a row finds its shard among every step-th count, then within that group
    step = max(1, math.isqrt(n_shards))
    upto = _table(spark, [np.cumsum(r).tolist() for r in matrix], ("of_block", "upto")).withColumn("ends", F.filter("upto", lambda u, i: i % step == step - 1))
    ties: list[Column] = [F.col(c).asc_nulls_first() for c in ("h", "key", "size")]
    local = Window.partitionBy("block").orderBy(F.xxhash64("h", F.lit(2)), *ties)
    dealt = rows.withColumn("block", block).withColumn("place", F.row_number().over(local)).join(F.broadcast(upto), F.col("block") == F.col("of_block"))
    dealt = dealt.select("key", "size", "crc", "h", _before("ends").alias("group"), "upto", "place")
    within = F.size(F.filter(F.slice("upto", F.col("group") * step + 1, F.lit(step)), lambda u: u < F.col("place")))
    dealt = dealt.select("key", "size", "crc", "h", (F.col("group") * step + within).alias("shard"))
    n_subs = max(1, min(MAX_BLOCKS, math.ceil(total / n_shards / BLOCK_ROWS)))
    dealt = written(dealt.withColumn("sub", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(n_subs)).cast("int")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "sub").orderBy(F.xxhash64("h", F.lit(4)), *ties)
    return dealt.withColumn("place", F.row_number().over(again) - 1).join(starts, ["shard", "sub"]).select(
        "key", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 17) -> None:
    """Write ``docs`` as one folder for each shard, rows in slot order within each file; keys must be unique."""
    places = shuffle_to_shards(docs, n_shards, key, text, seed).select(F.col("key").alias("__place_key"), "shard", "slot")
    rows = docs.join(places, F.col(key).eqNullSafe(F.col("__place_key"))).drop("__place_key")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
