"""Linkage disequilibrium: pair statistics in position blocks, scores, decay, blocks, clumping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands


#: Samples in one tile of calls; a task's matrices have at most so many columns.
TILE = 16_384


def _tiled(calls: DataFrame, variants: DataFrame, window: int, tile: int) -> DataFrame:
    """(chr, block, tile, own, v_idx, pos, s, d): the calls of a variant and a tile of samples packed in two arrays, in each block that needs them."""
    rows = calls.where(F.col("dosage").isNotNull()).groupBy("v_idx", F.floor(F.col("s_idx") / tile).cast("long").alias("tile"))
    packed = rows.agg(F.array_sort(F.collect_list(F.struct((F.col("s_idx") % tile).cast("int").alias("s"), F.col("dosage").alias("d")))).alias("x"))
    packed = packed.select("v_idx", "tile", F.col("x.s").alias("s"), F.col("x.d").alias("d")).join(variants.select("v_idx", "chr", "pos"), "v_idx")
    own = F.floor(F.col("pos") / window)
    return packed.withColumn("own", own).withColumn("block", F.explode(F.array("own", F.col("own") - 1)))


def _pair_sums(calls: DataFrame, variants: DataFrame, window: int, tile: int, columns: list[str], sums) -> DataFrame:
    """(chr, i, j, pos_i, pos_j, columns) with ``sums(x, here, i, j)`` added up over the tiles of samples.

    A chromosome is cut into blocks of ``window`` bases. Each block's task also gets the next
    block's variants, so every pair meets in exactly one block; a task holds two blocks of
    variants and one tile of samples, however long the chromosome and however many the samples.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v_idx")
        v, pos = group["v_idx"].to_numpy(), group["pos"].to_numpy(np.int64)
        mine = (group["own"] == group["block"]).to_numpy()
        counts = group["s"].map(len).to_numpy()
        at, who = np.repeat(np.arange(len(v)), counts), np.concatenate(group["s"].to_numpy())
        names, who = np.unique(who, return_inverse=True)
        x, here = np.zeros((len(v), len(names))), np.zeros((len(v), len(names)))
        x[at, who], here[at, who] = np.concatenate(group["d"].to_numpy()), 1.0
        gap = pos[None] - pos[:, None]
        i, j = np.nonzero((gap > 0) & (gap <= window) & mine[:, None])
        out = pd.DataFrame({"chr": group["chr"].iloc[0], "i": v[i], "j": v[j], "pos_i": pos[i], "pos_j": pos[j]})
        return pd.concat([out, pd.DataFrame(sums(x, here, i, j), columns=columns)], axis=1)

    keys = "chr string, i long, j long, pos_i long, pos_j long"
    rows = _tiled(calls, variants, window, tile).groupBy("chr", "block", "tile").applyInPandas(run, ", ".join([keys, *(f"{c} double" for c in columns)]))
    return rows.groupBy("chr", "i", "j", "pos_i", "pos_j").agg(*(F.sum(c).alias(c) for c in columns))


def _moments(x: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n, s, q, c = here @ here.T, x @ here.T, (x * x) @ here.T, x @ x.T
    return np.stack([n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], c[i, j]], axis=1)


def pair_correlations(calls: DataFrame, variants: DataFrame, window: int, tile: int = TILE) -> DataFrame:
    """(chr, i, j, pos_i, pos_j, n, r) of pairs within ``window`` bases on one chromosome, over the samples that both variants have."""
    m = _pair_sums(calls, variants, window, tile, ["n", "si", "sj", "qi", "qj", "c"], _moments)
    var_i, var_j = F.col("n") * F.col("qi") - F.col("si") * F.col("si"), F.col("n") * F.col("qj") - F.col("sj") * F.col("sj")
    r = (F.col("n") * F.col("c") - F.col("si") * F.col("sj")) / F.sqrt(var_i * var_j)
    kept = m.where((var_i > 1e-9) & (var_j > 1e-9))
    return kept.select("chr", "i", "j", "pos_i", "pos_j", F.col("n").cast("long").alias("n"), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)).alias("r"))


def genotype_tables(calls: DataFrame, variants: DataFrame, window: int, tile: int = TILE) -> DataFrame:
    """(chr, i, j, pos_i, pos_j, n, c): how many samples have each of the nine pairs of rounded dosages; c is by rows of the first variant."""

    def counts(x: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        classes = np.clip(np.rint(x), 0, 2)
        flags = [(classes == k) * here for k in range(3)]
        return np.stack([(flags[a] @ flags[b].T)[i, j] for a in range(3) for b in range(3)], axis=1)

    names = [f"c{k}" for k in range(9)]
    m = _pair_sums(calls, variants, window, tile, names, counts)
    return m.select("chr", "i", "j", "pos_i", "pos_j", sum((F.col(c) for c in names[1:]), F.col("c0")).cast("long").alias("n"), F.array(*names).alias("c"))


def scores(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """LD score of each variant: the sum of r2 with its neighbours and itself."""
    r2 = F.col("r") * F.col("r")
    both = pairs.select(F.col("i").alias("v_idx"), r2.alias("r2")).unionByName(pairs.select(F.col("j").alias("v_idx"), r2.alias("r2")))
    sums = both.groupBy("v_idx").agg(F.sum("r2").alias("rest"), F.count("*").alias("k"))
    return variants.select("v_idx").join(sums, "v_idx", "left").select("v_idx", (1 + F.coalesce("rest", F.lit(0.0))).alias("ld_score"), F.coalesce("k", F.lit(0)).alias("n_neighbours"))


def decay_signal(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Mean r2 of the k nearest pairs of each variant, by distance and then by partner."""
    gap, r2 = (F.col("pos_j") - F.col("pos_i")).alias("gap"), (F.col("r") * F.col("r")).alias("r2")
    both = pairs.select(F.col("i").alias("v_idx"), F.col("j").alias("other"), gap, r2).unionByName(pairs.select(F.col("j").alias("v_idx"), F.col("i").alias("other"), gap, r2))
    place = F.row_number().over(Window.partitionBy("v_idx").orderBy("gap", "other"))
    return both.withColumn("place", place).where(F.col("place") <= k).groupBy("v_idx").agg(F.avg("r2").alias("signal"))


def with_previous(variants: DataFrame) -> DataFrame:
    own = Window.partitionBy("chr").orderBy("pos", "v_idx")
    return variants.withColumn("previous", F.lag("v_idx").over(own))


def adjacent_blocks(variants: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Blocks of consecutive variants whose r2 with the one before is at least ``threshold``."""
    r2 = pairs.select(F.col("i").alias("previous"), F.col("j").alias("v_idx"), (F.col("r") * F.col("r")).alias("r2"))
    rows = with_previous(variants).join(r2, ["previous", "v_idx"], "left")
    rows = islands(rows, F.col("r2").isNull() | (F.round("r2", 9) < threshold), ["chr"], ["pos", "v_idx"], "block")
    return summarise(rows)


def summarise(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chr", "block").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n_variants"))


def four_gamete_blocks(haplotypes: DataFrame, variants: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Blocks that break where all four gametes of neighbouring variants exceed a share of the haplotypes.

    haplotypes: (v_idx, h_idx, allele) with alleles 0 and 1.
    """
    near = with_previous(variants).where(F.col("previous").isNotNull()).select("v_idx", "previous")
    own, before = haplotypes.alias("a"), haplotypes.withColumnsRenamed({"v_idx": "previous", "allele": "before"}).alias("b")
    pairs = near.join(own, "v_idx").join(before, ["previous", "h_idx"])
    gamete = F.col("allele") * 2 + F.col("before")
    counts = pairs.groupBy("v_idx").agg(F.count("*").alias("n"), *(F.count(F.when(gamete == g, 1)).alias(f"g{g}") for g in range(4)))
    breaks = counts.select("v_idx", F.least(*(F.col(f"g{g}") for g in range(4))).alias("least"), "n").select("v_idx", (F.col("least") > threshold * F.col("n")).alias("breaks"))
    rows = with_previous(variants).join(breaks, "v_idx", "left")
    return summarise(islands(rows, F.col("previous").isNull() | F.coalesce("breaks", F.lit(False)), ["chr"], ["pos", "v_idx"], "block"))


def dprime(p_ab: Column, p_a: Column, p_b: Column) -> Column:
    """|D'| from haplotype and allele frequencies."""
    d = p_ab - p_a * p_b
    most = F.when(d >= 0, F.least(p_a * (1 - p_b), (1 - p_a) * p_b)).otherwise(F.least(p_a * p_b, (1 - p_a) * (1 - p_b)))
    return F.when(most > 1e-12, F.abs(d) / most).otherwise(0.0)


def dprime_pairs(haplotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, dprime) of phased pairs."""
    a, b = haplotypes.withColumnsRenamed({"v_idx": "i", "allele": "x"}), haplotypes.withColumnsRenamed({"v_idx": "j", "allele": "y"})
    rows = pairs.select("i", "j").join(a, "i").join(b, ["j", "h_idx"])
    m = rows.groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("ab"), F.avg("x").alias("a"), F.avg("y").alias("b"))
    return m.select("i", "j", dprime(F.col("ab"), F.col("a"), F.col("b")).alias("dprime"))


def clump(hits: DataFrame, pairs: DataFrame, p_threshold: float, r2_threshold: float) -> DataFrame:
    """Greedy clumps: (chr, index, member). hits: v_idx, chr, p; pairs from `pair_correlations`.

    Clumps touch through strong pairs only. Where no strong pair spans a gap between neighbouring
    variants, the chromosome falls apart, so the greedy step, in order of (p, v_idx), runs by such
    a run of variants. A hit without a strong pair is a clump of its own.
    """
    strong = pairs.where(F.col("r") * F.col("r") >= r2_threshold)
    ends = strong.select("chr", F.col("i").alias("v_idx"), F.col("pos_i").alias("pos"), F.col("pos_j").alias("reach"))
    ends = ends.unionByName(strong.select("chr", F.col("j").alias("v_idx"), F.col("pos_j").alias("pos"), F.col("pos_j").alias("reach")))
    ends = ends.groupBy("chr", "v_idx", "pos").agg(F.max("reach").alias("reach"))
    earlier = Window.partitionBy("chr").orderBy("pos", "v_idx").rowsBetween(Window.unboundedPreceding, -1)
    runs = islands(ends.withColumn("gap", F.col("pos") > F.max("reach").over(earlier)), F.col("gap"), ["chr"], ["pos", "v_idx"], "run").select("v_idx", "run")
    rows = hits.select("v_idx", "chr", "p").where(F.col("p") <= p_threshold).join(runs, "v_idx", "left")
    links = strong.select(F.col("chr").alias("of_chr"), "i", "j").join(runs.select(F.col("v_idx").alias("i"), F.col("run").alias("of_run")), "i")

    def greedy(group: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        others: dict[int, list[int]] = {}
        for a, b in zip(near["i"].tolist(), near["j"].tolist(), strict=True):
            others.setdefault(a, []).append(b)
            others.setdefault(b, []).append(a)
        taken: set[int] = set()
        out = []
        for v in group.sort_values(["p", "v_idx"])["v_idx"]:
            if v not in taken:
                own = [v, *(o for o in sorted(others.get(v, ())) if o not in taken)]
                taken.update(own)
                out += [(v, o) for o in own]
        chrom = group["chr"].iloc[0] if len(group) else ""
        return pd.DataFrame({"chr": chrom, "index": [a for a, _ in out], "member": [b for _, b in out]}).astype({"chr": "object", "index": "int64", "member": "int64"})

    alone = rows.where("run IS NULL").select("chr", F.col("v_idx").alias("index"), F.col("v_idx").alias("member"))
    together = rows.where("run IS NOT NULL").groupBy("chr", "run").cogroup(links.groupBy("of_chr", "of_run")).applyInPandas(greedy, "chr string, index long, member long")
    return together.unionByName(alone)


def prune_peaks(hits: DataFrame, p_threshold: float, window: int) -> DataFrame:
    """Greedy peaks: each absorbs the candidates within ``window`` bases; (chr, v_idx, n, start, end).

    Candidates further apart than the window can't touch, so a group is a run of candidates without such a gap.
    """

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["p", "pos", "v_idx"])
        pos, v = g["pos"].to_numpy(), g["v_idx"].to_numpy()
        left, out = np.ones(len(g), bool), []
        for k in range(len(g)):
            if left[k]:
                near = left & (np.abs(pos - pos[k]) <= window)
                left &= ~near
                out.append((v[k], int(near.sum()), max(0, pos[k] - window // 2), pos[k] + window // 2))
        return pd.DataFrame(out, columns=["v_idx", "n", "start", "end"]).assign(chr=group["chr"].iloc[0])

    own = Window.partitionBy("chr").orderBy("pos", "v_idx")
    rows = hits.where(F.col("p") <= p_threshold).select("v_idx", "chr", "pos", "p")
    rows = islands(rows, F.coalesce(F.col("pos") - F.lag("pos").over(own) > window, F.lit(True)), ["chr"], ["pos", "v_idx"], "run")
    return rows.groupBy("chr", "run").applyInPandas(greedy, "chr string, v_idx long, n long, start long, end long")
