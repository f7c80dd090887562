"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's share is a multiple f of its size. Every document of it is taken floor(f) times,
and once more with probability f - floor(f). Which documents come once more is decided by the
cube method: probabilities move along the null space of two constraints, the number of words
and the number of documents, until each is 0 or 1. Three documents at a time suffice for two
constraints; each move settles one of them. What can't move any more, two documents at most,
goes up a level.

Scale: only (key, source, size) move. A source is cut into blocks of about BLOCK_ROWS rows by a
hash of key and text, and of their number where rows repeat, however many rows it has; the flight of a block is one group of bounded size.
The at most two open documents of each block meet in the next level's blocks, until a source
has one block, where the landing drops the constraints one by one. Long documents come first, so
what lands is short and a source misses its target by little.

Defined results: a null text has size 0; null sources form one source, last in order; empty
documents are taken but add no words; rows that repeat are sampled one by one; an empty table
gives an empty result; the same rows and seed give the same mix, however they are partitioned.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_words, told_apart, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its words, its rows and its target, from (source, size) rows.

    Targets are min(most * size, level * weight), where the level makes them sum to the share:
    with sources by the ratio at which they fill up, it is the first level that the source at
    hand doesn't reach. One row for each source goes through one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights))
    cap = most * F.col("source_size")
    sums = sums.withColumn("weight", weight).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_ratio.rowsBetween(0, Window.unboundedFollowing)
    )
    levels = sums.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    first = F.coalesce(F.max(fits).over(whole), F.max("full_at").over(whole))
    return levels.withColumn("at", first).select("source", "source_size", "source_rows", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def fly(chances: list[float], sizes: list[float], rng: random.Random) -> list[int]:
    """Flight in place: afterwards all but the returned places (two at most) are 0 or 1."""
    open_: list[int] = []
    for k in range(len(chances)):
        if not 0.0 < chances[k] < 1.0:
            continue
        open_.append(k)
        if len(open_) == 3:
            a, b, c = open_
            move = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if move == (0, 0, 0):
                move = (1.0, -1.0, 0.0)
            open_ = _step(chances, open_, move, rng)
    return open_


def _step(chances: list[float], at: list[int], move: tuple[float, ...], rng: random.Random) -> list[int]:
    """Go along ``move`` or against it, as chance has it, to the next face of the cube."""
    ahead = back = math.inf
    for k, u in zip(at, move, strict=True):
        if u:
            up, down = (1.0 - chances[k]) / abs(u), chances[k] / abs(u)
            ahead, back = (min(ahead, up), min(back, down)) if u > 0 else (min(ahead, down), min(back, up))
    by = ahead if rng.random() * (ahead + back) < back else -back
    for k, u in zip(at, move, strict=True):
        x = chances[k] + by * u
        chances[k] = 0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x
    return [k for k in at if 0.0 < chances[k] < 1.0]


def land(chances: list[float], sizes: list[float], at: list[int], rng: random.Random) -> None:
    """Settle the last places: first without the number of documents, then without the words."""
    while len(at) >= 2:
        a, b = at[:2]
        move = (sizes[b], -sizes[a]) if sizes[a] or sizes[b] else (1.0, -1.0)
        at = _step(chances, [a, b], move, rng) + at[2:]
    for k in at:
        chances[k] = float(rng.random() < chances[k])


def _level(rows: DataFrame, seed: int, level: int) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        chances, sizes = group["chance"].tolist(), group["size"].astype(float).tolist()
        rng = random.Random(f"{seed}:{level}:{group['source_h'].iloc[0]}:{group['block'].iloc[0]}")
        at = fly(chances, sizes, rng)
        if group["blocks"].iloc[0] == 1:
            land(chances, sizes, at, rng)
        return group.assign(chance=chances)

    return rows.groupBy("source_h", "block").applyInPandas(one, rows.schema)


def mix_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 29, row: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target (both its source's) and copies; row, if a column of that name is carried."""
    carried = [F.col(row).alias("row")] if row else []
    sized = docs.select(*carried, F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
    value = F.xxhash64("h", "source", F.col("source").isNull())
    first = written(sized.withColumn("value", value).withColumn("split", F.spark_partition_id()), "mix-first")
    sized = written(told_apart(first, "value").drop("value"), "mix-sizes")
    discard(first)
    targets = written(source_targets(sized, weights, share, most), "mix-targets")
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("source_rows") / BLOCK_ROWS).cast("long")
    rows = rows.select(
        *["row"] * bool(row), "key", "size", "source_size", "target", "h", F.xxhash64("d.source", F.col("d.source").isNull()).alias("source_h"),
        F.floor(times).cast("long").alias("whole"), (times - F.floor(times)).alias("chance"), F.pmod("h", blocks).alias("block"), blocks.alias("blocks"),
    )
    most_blocks, level, done = targets.agg(F.max(F.ceil(F.col("source_rows") / BLOCK_ROWS))).first()[0] or 1, 0, []
    while True:
        rows, level = written(_level(rows, seed, level), "mix-level"), level + 1
        if most_blocks == 1:
            break
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(rows.where(~is_open))
        fewer = F.ceil(F.col("blocks") * 2 / BLOCK_ROWS).cast("long")
        rows = rows.where(is_open).withColumn("block", F.pmod("block", fewer)).withColumn("blocks", fewer)
        most_blocks = math.ceil(most_blocks * 2 / BLOCK_ROWS)
    for part in done:
        rows = rows.unionByName(part)
    return rows.select(*["row"] * bool(row), "key", "size", "source_size", "target", (F.col("whole") + F.col("chance").cast("long")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    The rows are numbered and written first, so each has its own count even where keys or whole
    rows repeat or are null.
    """
    rows = written(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-rows")
    copies = mix_counts(rows, key, row="__mix_row", **options).select(F.col("row").alias("__mix_of"), F.col("copies").cast("int").alias("__mix_copies")).where("__mix_copies > 0")
    taken = rows.join(copies, F.col("__mix_row") == F.col("__mix_of"))
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies"))).alias("__mix_nth")).select(*docs.columns)
