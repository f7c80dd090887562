"""Nearly independent LD blocks: cuts of a chromosome that the least LD crosses.

The cost of a cut is the sum of r^2 over the pairs of variants on its two sides. A pair adds to all
cuts from its first variant to its last, so the costs are running sums of what begins and ends at each
variant: one aggregation of the pairs, however wide the window. The cuts are those of least total
cost with blocks of bounded size, by a dynamic programme over (place, cost) alone; no pair reaches it.
Pairs that no cut separates stay whole; what a block method then leaves out is the cost of its cuts.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_costs(variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chr, v_idx, place, cost): each variant's place by position, from 1, and the cost of a cut right after it.

    ``variants`` (v_idx, chr, pos), ``pairs`` (i, j, r) in any order; pairs of two chromosomes and null r count nothing.
    """
    own = Window.partitionBy("chr").orderBy("pos", "v_idx")
    placed = variants.select("chr", "v_idx", F.row_number().over(own).alias("place"))
    at = lambda c: placed.select(F.col("v_idx").alias(c), F.col("chr").alias(f"chr_{c}"), F.col("place").alias(f"at_{c}"))
    both = pairs.where(F.col("r").isNotNull()).select("i", "j", (F.col("r") * F.col("r")).alias("r2")).join(at("i"), "i").join(at("j"), "j").where("chr_i = chr_j")
    ends = both.select(F.col("chr_i").alias("chr"), F.explode(F.array(F.struct(F.least("at_i", "at_j").alias("place"), F.col("r2").alias("x")), F.struct(F.greatest("at_i", "at_j").alias("place"), (-F.col("r2")).alias("x")))).alias("e"))
    sums = ends.groupBy("chr", "e.place").agg(F.sum("e.x").alias("x")).withColumnRenamed("place", "at")
    rows = placed.join(sums.withColumnRenamed("chr", "of"), (F.col("chr") == F.col("of")) & (F.col("place") == F.col("at")), "left")
    running = F.sum(F.coalesce("x", F.lit(0.0))).over(Window.partitionBy("chr").orderBy("place"))
    # what is left of a sum that should be zero is rounding
    return rows.select("chr", "v_idx", "place", F.greatest(F.lit(0.0), F.round(running, 9)).alias("cost"))


def best_cuts(cost: np.ndarray, least: int, most: int) -> np.ndarray:
    """Ends of the blocks (places, the last one included) of least total cost, with ``least`` to ``most`` variants each; the last may have fewer.

    Of equal totals that with the shorter last block.
    """
    n = len(cost)
    total, before = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0] = 0.0
    window: deque[int] = deque()  # places of block ends that could be the best, by rising total
    for k in range(1, n + 1):
        if (new := k - least) >= 0 and np.isfinite(total[new]):
            while window and total[window[-1]] >= total[new]:
                window.pop()
            window.append(new)
        while window and window[0] < k - most:
            window.popleft()
        if window:
            total[k], before[k] = total[window[0]] + cost[k - 1], window[0]
    near = np.arange(max(0, n - most), n)
    last = near[len(near) - 1 - int(np.argmin(total[near][::-1]))]
    cuts = [n]
    while last > 0:
        cuts.append(int(last))
        last = before[last]
    return np.array(cuts[::-1])


def blocks(variants: DataFrame, pairs: DataFrame, least: int = 200, most: int = 2000) -> DataFrame:
    """(v_idx, block, cost): the block of each variant, and the cost of the cut after it where it ends a block (else 0)."""
    if not 1 <= least <= most:
        raise ValueError("blocks need 1 <= least <= most")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        cost = rows["cost"].to_numpy(float)
        ends = best_cuts(cost, least, most)
        number = np.searchsorted(ends, np.arange(1, len(rows) + 1))
        ending = np.isin(np.arange(1, len(rows) + 1), ends[:-1])
        return pd.DataFrame({"v_idx": rows["v_idx"].to_numpy(), "block": [f"{c}:{k}" for c, k in zip(rows["chr"], number, strict=True)], "cost": np.where(ending, cost, 0.0)})

    return cut_costs(variants, pairs).groupBy("chr").applyInPandas(cut, "v_idx long, block string, cost double")
