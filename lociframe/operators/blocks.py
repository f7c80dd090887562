"""LD block detection on the pair table of one chromosome, and comparison of block sets.

Each method is a function of a Band, the pair statistics of a chromosome's variants in order of
position; `detect` applies it by chromosome. A band holds as many partners for each variant as the
pairs' window reached, so a task holds a strip of the LD matrix and not the square, and no block is
wider than the window. Methods that need calls get them as one array for each variant.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Blocks = list[tuple[int, int]]


class Band:
    """Statistics of near pairs by place: ``get(name)[a, k]`` is that of a and a + 1 + k; 0 where there is no pair."""

    def __init__(self, variants: pd.DataFrame, pairs: pd.DataFrame, calls: np.ndarray | None = None):
        self.v, self.pos, self.calls = variants["v_idx"].to_numpy(), variants["pos"].to_numpy(), calls
        self.m = len(self.v)
        place = pd.Series(np.arange(self.m), index=self.v)
        i, j = place.loc[pairs["i"]].to_numpy(), place.loc[pairs["j"]].to_numpy()
        self.i, self.j = np.minimum(i, j), np.maximum(i, j)
        self.width = int((self.j - self.i).max(initial=0))
        self.known = self._laid(np.ones(len(pairs)))
        self.values = {name: self._laid(pairs[name].to_numpy(float)) for name in pairs.columns if name not in ("i", "j", "of_chr")}
        self.values["r2"] = self.values["r"] ** 2

    def _laid(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.m, self.width))
        out[self.i, self.j - self.i - 1] = values
        return out

    def get(self, name: str) -> np.ndarray:
        return self.values[name]

    def square(self, name: str, a: int, b: int) -> np.ndarray:
        """The symmetric matrix of the variants a .. b, 1 on the diagonal."""
        out = np.eye(b - a + 1)
        for k in range(min(self.width, b - a)):
            own = self.values[name][a : b - k, k]
            at = np.arange(len(own))
            out[at, at + k + 1] = out[at + k + 1, at] = own
        return out

    def triangles(self, *strips: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(length, sums over the pairs inside a .. a + length for each a) for each strip, by growing length."""
        columns, sums = [np.zeros(self.m + 1) for _ in strips], [np.zeros(self.m) for _ in strips]
        for length in range(1, self.width + 1):
            left = self.m - length
            for k, strip in enumerate(strips):
                columns[k] = columns[k][1 : left + 1] + strip[:left, length - 1]
                sums[k] = sums[k][:left] + columns[k]
            yield length, sums


def spine(band: Band, threshold: float = 0.8, least: int = 2) -> Blocks:
    """Solid spine: a block takes the next variant while its |D'| with every variant of the block is strong."""
    strip, out, a = band.get("dprime"), [], 0
    while a < band.m:
        b = a
        while b + 1 < band.m and b + 1 - a <= band.width and (strip[np.arange(a, b + 1), b - np.arange(a, b + 1)] >= threshold).all():
            b += 1
        if b - a + 1 >= least:
            out.append((a, b))
            a = b + 1
        else:
            a += 1
    return out


def _disjoint(candidates: list[tuple[int, int]], m: int) -> Blocks:
    """The candidates that overlap none taken before, in the order given."""
    free, out = np.ones(m, bool), []
    for a, b in candidates:
        if free[a : b + 1].all():
            out.append((a, b))
            free[a : b + 1] = False
    return sorted(out)


def gabriel(band: Band, low: float = 0.70, high: float = 0.98, recombinant: float = 0.90, share: float = 0.95, most: float = 0.04, least: int = 2) -> Blocks:
    """Confidence limits of D': of the pairs inside that tell anything, enough are strong and few recombinant; longest first."""
    known = band.known > 0
    strong = known & (band.get("low") > low) & (band.get("high") > high)
    weak = known & (band.get("high") < recombinant)
    found = []
    for length, (s, w, told) in band.triangles(strong.astype(float), weak.astype(float), (strong | weak).astype(float)):
        if length + 1 >= least:
            at = np.flatnonzero((told > 0) & (s >= share * told) & (w < most * told))
            found += [(length, a) for a in at.tolist()]
    return _disjoint([(a, a + n) for n, a in sorted(found, reverse=True)], band.m)


def big_ld(band: Band, threshold: float = 0.5, least: int = 2, span: int = 200) -> Blocks:
    """Intervals whose mean r2 reaches the threshold, weighted by variants times mean, chosen greedily without overlap."""
    found = []
    for length, (total,) in band.triangles(band.get("r2")):
        if least <= length + 1 <= span:
            mean = total / (length * (length + 1) / 2)
            at = np.flatnonzero(mean >= threshold)
            found += zip((-(length + 1) * mean[at]).tolist(), at.tolist(), (at + length).tolist(), strict=True)
    return _disjoint([(a, b) for _, a, b in sorted(found)], band.m)


def changepoint(signal: np.ndarray, penalty: float, least: int = 1, cost: str = "gaussian") -> Blocks:
    """Segments of least cost plus a penalty each, by dynamic programming.

    Costs are squared deviation from the mean (gaussian; starts that can't win any more are pruned)
    or length times mean less the sum of the mean's logarithm (poisson).
    """
    n = len(signal)
    s, q = np.concatenate(([0.0], np.cumsum(signal))), np.concatenate(([0.0], np.cumsum(signal**2)))
    best, back, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for t in range(least, n + 1):
        starts = live[live <= t - least]
        length, total = t - starts, s[t] - s[starts]
        if cost == "poisson":
            mean = np.maximum(total / length, 1e-10)
            own = length * mean - total * np.log(mean)
        else:
            own = (q[t] - q[starts]) - total**2 / length
        value = best[starts] + own
        if len(value):
            k = int(np.argmin(value))
            best[t], back[t] = value[k] + penalty, starts[k]
            if cost != "poisson" and least == 1:
                live = live[value <= best[t]]
        live = np.append(live, t)
    if not np.isfinite(best[n]):
        return [(0, n - 1)] if n else []
    out, t = [], n
    while t:
        out.append((int(back[t]), t - 1))
        t = int(back[t])
    return out[::-1]


def by_signal(band: Band, penalty: float = 0.0, least: int = 2, cost: str = "gaussian") -> Blocks:
    """Change points of each variant's mean r2 with its neighbours on either side; penalty 0 is twice the logarithm of their number."""
    if band.m < 2 * least:
        return []
    near = band.get("r2")[: band.m - 1, 0] if band.width else np.zeros(band.m - 1)
    total, n = np.zeros(band.m), np.zeros(band.m)
    total[:-1], total[1:] = total[:-1] + near, total[1:] + near
    n[:-1], n[1:] = n[:-1] + 1, n[1:] + 1
    return [(a, b) for a, b in changepoint(total / np.maximum(n, 1), penalty or 2 * math.log(max(band.m, 2)), least, cost) if b - a + 1 >= least]


def _partition(m: int, least: int, most: int, gain: Callable[[int], np.ndarray]) -> Blocks:
    """Best chain of segments of least .. most places; gain(t) is that of the segments t - most .. t - least up to t, best last partition first."""
    best, back = np.full(m + 1, -np.inf), np.zeros(m + 1, int)
    best[0] = 0.0
    for t in range(least, m + 1):
        starts = np.arange(max(0, t - most), t - least + 1)
        value = best[starts] + gain(t)[-len(starts) :]
        k = int(np.argmax(value))
        if value[k] > best[t]:
            best[t], back[t] = value[k], starts[k]
    t = m
    while t > 0 and best[t] == -np.inf:
        t -= 1
    out = []
    while t > 0:
        out.append((int(back[t]), t - 1))
        t = int(back[t])
    return out[::-1]


def _tags(r2: np.ndarray, threshold: float) -> int:
    """Variants that a greedy cover needs so that each is tagged at r2 >= threshold."""
    near, left, n = r2 >= threshold, np.ones(len(r2), bool), 0
    while left.any():
        k = int(np.argmax(np.where(left, (near & left).sum(axis=1), -1)))
        left &= ~near[k]
        left[k] = False
        n += 1
    return n


def dp(band: Band, objective: str = "haplotypes", penalty: float = 0.0, least: int = 2, most: int = 50, frequent: float = 0.01, tagged: float = 0.8) -> Blocks:
    """Partition with the least cost and penalty for each block: common genotype patterns, or greedy tag variants. Penalty 0 is the logarithm of the number of variants."""
    penalty = penalty or math.log(max(band.m, 2))
    if objective == "tags":

        def gain(t: int) -> np.ndarray:
            return -np.array([_tags(band.square("r2", a, t - 1), tagged) + penalty for a in range(max(0, t - most), t - least + 1)])

        return _partition(band.m, least, most, gain)
    if band.calls is None:
        raise ValueError("patterns are counted on calls")
    classes = np.clip(np.rint(band.calls), 0, 2).astype(np.int64)
    enough = max(1, int(frequent * classes.shape[1]))

    def patterns(t: int) -> np.ndarray:
        own, out = np.zeros(classes.shape[1], np.int64), []
        for a in range(t - 1, max(0, t - most) - 1, -1):
            _, own, counts = np.unique(own * 3 + classes[a], return_inverse=True, return_counts=True)
            if t - a >= least:
                out.append(-((counts >= enough).sum() + penalty))
        return np.array(out[::-1])

    return _partition(band.m, least, most, patterns)


def aligned(band: Band, penalty: float = 0.1, least: int = 2, most: int = 50) -> Blocks:
    """Partition with the most variance in the leading axis of each block's r2 matrix, less a penalty on its condition number."""

    def gain(t: int) -> np.ndarray:
        out = []
        for a in range(max(0, t - most), t - least + 1):
            values = np.linalg.eigvalsh(band.square("r2", a, t - 1))
            out.append(values[-1] / max(values.sum(), 1e-10) - penalty * math.log(max(values[-1] / max(values[0], 1e-10), 1.0)))
        return np.array(out)

    return _partition(band.m, least, most, gain)


def graph_components(band: Band, threshold: float = 0.5, span: int = 100, least: int = 1) -> list[list[int]]:
    """Variants that chains of pairs with r2 above the threshold connect; single ones too if ``least`` is 1."""
    parent = np.arange(band.m)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    a, k = np.nonzero(band.get("r2")[:, : min(span, band.width)] > threshold)
    for x, y in zip(a.tolist(), (a + k + 1).tolist(), strict=True):
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    groups: dict[int, list[int]] = {}
    for k in range(band.m):
        groups.setdefault(root(k), []).append(k)
    return [g for g in groups.values() if len(g) >= max(least, 1)]


def laplacian(weights: np.ndarray, normalised: bool = False) -> np.ndarray:
    """Degree matrix less the weights; or the identity less the weights over the roots of both degrees."""
    degree = weights.sum(axis=1)
    if not normalised:
        return np.diag(degree) - weights
    root = 1 / np.sqrt(np.maximum(degree, 1e-10))
    return np.eye(len(weights)) - root[:, None] * weights * root[None]


def spectral(weights: np.ndarray, k: int, least: int = 1, rounds: int = 100) -> list[list[int]]:
    """Clusters of rows by the leading axes of the normalised Laplacian: k-means from evenly spaced rows; clusters below ``least`` are left out."""
    _, vectors = np.linalg.eigh(laplacian(weights, normalised=True))
    x = vectors[:, :k] / np.maximum(np.linalg.norm(vectors[:, :k], axis=1, keepdims=True), 1e-10)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    label = np.zeros(len(x), int)
    for n in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if n and (new == label).all():
            break
        label = new
        centres = np.stack([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
    return [np.flatnonzero(label == c).tolist() for c in range(k) if (label == c).sum() >= least]


def sparse_precision(s: np.ndarray, penalty: float = 0.1, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Sparse inverse of a covariance matrix: proximal gradient steps on the likelihood with an absolute penalty off the diagonal."""
    theta = np.diag(1 / np.maximum(np.diag(s), 1e-10))
    step = 1 / (np.linalg.norm(s) + penalty + 1e-10)
    off = ~np.eye(len(s), dtype=bool)
    for _ in range(rounds):
        new = theta - step * (s - np.linalg.pinv(theta))
        shrunk = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new = np.where(off, shrunk, np.maximum(new, 1e-10))
        new = (new + new.T) / 2
        moved = np.abs(new - theta).max()
        theta = new
        if moved < tol:
            break
    return theta


def graphical(band: Band, penalty: float = 0.1, window: int = 100, overlap: int = 20, least: int = 2) -> list[list[int]]:
    """Variants that the sparse precision matrices of overlapping windows connect."""
    if band.calls is None:
        raise ValueError("precision is estimated from calls")
    links = []
    for a in range(0, band.m, window - overlap):
        own = band.calls[a : a + window]
        if len(own) >= least:
            theta = sparse_precision(np.cov(own, ddof=1).reshape(len(own), len(own)) + 1e-10 * np.eye(len(own)), penalty)
            x, y = np.nonzero(np.triu(np.abs(theta) > 1e-10, 1))
            links += zip((x + a).tolist(), (y + a).tolist(), strict=True)
    parent = list(range(band.m))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in links:
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    groups: dict[int, list[int]] = {}
    for k in range(band.m):
        groups.setdefault(root(k), []).append(k)
    return [g for g in groups.values() if len(g) >= least]


def cross_population(bands: list[Band], weights: list[float], hint: int = 0, stable: float = 0.5, least: int = 2, how: str = "mean") -> list[tuple[list[int], float]]:
    """(members, stability) of spectral clusters of the populations' joint r2 matrix; stability is the smallest over the largest mean r2 of a cluster."""
    squares = [b.square("r2", 0, b.m - 1) for b in bands]
    m = bands[0].m
    stack = np.stack(squares)
    if how == "mean":
        joint = np.einsum("p,pij->ij", np.array(weights) / max(sum(weights), 1e-10), stack)
    elif how in ("min", "median"):
        joint = getattr(np, how)(stack, axis=0)
    else:
        raise ValueError(f"unknown way to join populations: {how}")
    if hint:
        k = min(hint, m)
    else:
        gaps = np.diff(np.linalg.eigvalsh(laplacian(joint, normalised=True)))
        k = min(max(2, int(np.argmax(gaps[: max(1, m // 2)])) + 2), max(1, m // least))
    out = []
    for own in spectral(joint, k, least):
        at = np.array(own)
        pairs = np.triu_indices(len(at), 1)
        means = [float(s[np.ix_(at, at)][pairs].mean()) for s in squares]
        stability = min(means) / max(max(means), 1e-10)
        if stability >= stable:
            out.append((own, stability))
    return out


def corrected_r2(band: Band, noise: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """The strip of r2 over the reliabilities of both variants, one less the share of a dosage's variance that is uncertainty."""
    reliable = np.clip(1 - noise / np.maximum(variance, 1e-10), 1e-10, 1.0)
    other = np.stack([np.concatenate([reliable[k + 1 :], np.ones(min(k + 1, band.m))])[: band.m] for k in range(band.width)], axis=1) if band.width else np.ones((band.m, 0))
    return np.clip(band.get("r2") / np.maximum(reliable[:, None] * other, 1e-10), 0, 1) * (band.known > 0)


def edge_weights(r2: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """A strip of r2 times the root of both variants' imputation quality."""
    m, width = r2.shape
    other = np.stack([np.concatenate([quality[k + 1 :], np.zeros(min(k + 1, m))])[:m] for k in range(width)], axis=1) if width else np.zeros((m, 0))
    return r2 * np.sqrt(np.maximum(quality[:, None] * other, 0))


def uncertain(band: Band, noise: np.ndarray, variance: np.ndarray, quality: np.ndarray, threshold: float = 0.2, good: float = 0.3, least: int = 2) -> Blocks:
    """Runs of neighbours whose corrected and weighted r2 reaches the threshold; a variant of low quality ends a run."""
    strip = edge_weights(corrected_r2(band, noise, variance), quality)
    near = strip[: band.m - 1, 0] if band.width else np.zeros(max(0, band.m - 1))
    near = near * ((quality[:-1] >= good) & (quality[1:] >= good))
    cuts = [0, *(np.flatnonzero(near < threshold) + 1).tolist(), band.m]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:]) if b - a >= least]


def blockiness(band: Band, threshold: float = 0.7, permutations: int = 0, seed: int = 0) -> dict[str, float]:
    """Share of pairs with strong D', the r2 of neighbours over that of all pairs (1 at most), their product and its permutation p."""
    known = band.known > 0
    dp_, r2 = band.get("dprime")[known], band.get("r2")[known]
    beside = np.broadcast_to(np.arange(band.width) == 0, known.shape)[known]
    q = float((dp_ > threshold).mean()) if len(dp_) else 0.0

    def ratio(values: np.ndarray) -> float:
        return min(float(values[beside].mean()) / max(float(values.mean()), 1e-10), 1.0) if beside.any() else 0.0

    adjacent = ratio(r2) if len(r2) else 0.0
    out = {"q": q, "q_adj": adjacent, "blockiness": q * adjacent}
    if permutations:
        rng = np.random.default_rng(seed)
        out["p"] = (1 + sum(q * ratio(rng.permutation(r2)) >= out["blockiness"] for _ in range(permutations))) / (1 + permutations)
    return out


METHODS: dict[str, Callable[..., list]] = {
    "spine": spine, "gabriel": gabriel, "big_ld": big_ld, "changepoint": by_signal, "dp": dp, "aligned": aligned, "cc_graph": graph_components, "graphical": graphical,
}
#: What a method needs besides r: D' with its limits, or calls.
NEEDS = {"spine": "dprime", "gabriel": "dprime", "dp": "calls", "graphical": "calls"}


def _calls(rows: pd.DataFrame) -> np.ndarray:
    """Variants by samples, missing calls at the variant's mean."""
    names = np.unique(np.concatenate(rows["s"].to_numpy()))
    out = np.full((len(rows), len(names)), np.nan)
    for k, (s, d) in enumerate(zip(rows["s"], rows["d"], strict=True)):
        out[k, np.searchsorted(names, s)] = d
    mean = np.nanmean(out, axis=1, keepdims=True)
    return np.where(np.isnan(out), mean, out)


def detect(variants: DataFrame, pairs: DataFrame, method: str, calls: DataFrame | None = None, **options) -> DataFrame:
    """(chr, block, start, end, n_variants, mean_r2) by one of METHODS.

    pairs has chr, i, j and r; spine and gabriel also need dprime, low and high. dp and graphical
    need calls (v_idx, s_idx, dosage), packed to one array for each variant.
    """
    work = METHODS[method]
    rows = variants.select("v_idx", "chr", "pos")
    if calls is not None:
        known = calls.where(F.col("dosage").isNotNull()).groupBy("v_idx").agg(F.array_sort(F.collect_list(F.struct("s_idx", "dosage"))).alias("x"))
        rows = rows.join(known.select("v_idx", F.col("x.s_idx").alias("s"), F.col("x.dosage").alias("d")), "v_idx")

    def run(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(["pos", "v_idx"]).reset_index(drop=True)
        band = Band(v, p, _calls(v) if "s" in v.columns else None)
        out = []
        for k, found in enumerate(work(band, **options)):
            members = list(range(found[0], found[1] + 1)) if isinstance(found, tuple) else found
            own = band.square("r2", members[0], members[-1])[np.ix_(np.array(members) - members[0], np.array(members) - members[0])]
            pairs_of = np.triu_indices(len(members), 1)
            out.append((v["chr"].iloc[0], k, int(band.pos[members[0]]), int(band.pos[members[-1]]), len(members), float(own[pairs_of].mean()) if len(members) > 1 else None))
        return pd.DataFrame(out, columns=["chr", "block", "start", "end", "n_variants", "mean_r2"])

    near = pairs.select(F.col("chr").alias("of_chr"), "i", "j", "r", *(c for c in ("dprime", "low", "high") if c in pairs.columns))
    return rows.groupBy("chr").cogroup(near.groupBy("of_chr")).applyInPandas(run, "chr string, block long, start long, end long, n_variants long, mean_r2 double")


def diagnose(variants: DataFrame, pairs: DataFrame, threshold: float = 0.7, permutations: int = 0, seed: int = 0) -> DataFrame:
    """(chr, n_variants, q, q_adj, blockiness, p) of each chromosome; p is null without permutations."""

    def run(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(["pos", "v_idx"]).reset_index(drop=True)
        found = {"p": None} | blockiness(Band(v, p), threshold, permutations, seed)
        return pd.DataFrame([{"chr": v["chr"].iloc[0], "n_variants": len(v)} | found])[["chr", "n_variants", "q", "q_adj", "blockiness", "p"]]

    near = pairs.select(F.col("chr").alias("of_chr"), "i", "j", "r", "dprime")
    return variants.select("v_idx", "chr", "pos").groupBy("chr").cogroup(near.groupBy("of_chr")).applyInPandas(run, "chr string, n_variants long, q double, q_adj double, blockiness double, p double")


def detect_uncertain(moments: DataFrame, variants: DataFrame, pairs: DataFrame, ploidy: int = 2, **options) -> DataFrame:
    """(chr, block, start, end, n_variants, quality) from expected dosages and their variances (v_idx, s_idx, expected, variance)."""
    stats = moments.groupBy("v_idx").agg(F.avg("variance").alias("noise"), F.var_samp("expected").alias("spread"), F.avg("expected").alias("mean"))
    af = F.col("mean") / ploidy
    quality = F.least(F.greatest(1 - F.col("noise") / F.greatest(ploidy * af * (1 - af), F.lit(1e-10)), F.lit(0.0)), F.lit(1.0))
    rows = variants.select("v_idx", "chr", "pos").join(stats.withColumn("quality", quality), "v_idx")

    def run(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(["pos", "v_idx"]).reset_index(drop=True)
        q = v["quality"].to_numpy()
        found = uncertain(Band(v, p), v["noise"].to_numpy(), v["spread"].to_numpy(), q, **options)
        out = [(v["chr"].iloc[0], k, int(v["pos"].iloc[a]), int(v["pos"].iloc[b]), b - a + 1, float(q[a : b + 1].mean())) for k, (a, b) in enumerate(found)]
        return pd.DataFrame(out, columns=["chr", "block", "start", "end", "n_variants", "quality"])

    near = pairs.select(F.col("chr").alias("of_chr"), "i", "j", "r")
    return rows.groupBy("chr").cogroup(near.groupBy("of_chr")).applyInPandas(run, "chr string, block long, start long, end long, n_variants long, quality double")


def detect_cross_population(variants: DataFrame, pairs: DataFrame, populations: list[str], weights: list[float] | None = None, **options) -> DataFrame:
    """(chr, block, start, end, n_variants, stability); pairs has a column population besides chr, i, j and r."""
    w = weights or [1 / len(populations)] * len(populations)

    def run(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(["pos", "v_idx"]).reset_index(drop=True)
        bands = [Band(v, own) for name in populations if len(own := p[p["population"] == name].drop(columns="population"))]
        found = cross_population(bands, w[: len(bands)], **options) if bands else []
        found = sorted(found, key=lambda f: f[0][0])
        out = [(v["chr"].iloc[0], k, int(v["pos"].iloc[at[0]]), int(v["pos"].iloc[at[-1]]), at[-1] - at[0] + 1, s) for k, (at, s) in enumerate(found)]
        return pd.DataFrame(out, columns=["chr", "block", "start", "end", "n_variants", "stability"])

    near = pairs.select(F.col("chr").alias("of_chr"), "population", "i", "j", "r")
    return variants.select("v_idx", "chr", "pos").groupBy("chr").cogroup(near.groupBy("of_chr")).applyInPandas(run, "chr string, block long, start long, end long, n_variants long, stability double")


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Jaccard index of the bases that two block sets (chr, start, end, n_variants) cover, and how many blocks overlap.

    Blocks of a set don't overlap, so shared bases come from overlapping blocks: a join on chr and range.
    """
    a = first.select("chr", F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = second.select("chr", F.col("start").alias("s2"), F.col("end").alias("e2"))
    width = F.greatest(F.least("e1", "e2") - F.greatest("s1", "s2"), F.lit(0))
    both = a.join(b, "chr").where("s1 <= e2 AND s2 <= e1").agg(F.coalesce(F.sum(width), F.lit(0)).alias("shared"), F.count("*").alias("overlaps"))
    one = first.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("first"), F.count("*").alias("n_first"))
    two = second.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("second"), F.count("*").alias("n_second"))
    rows = both.crossJoin(one).crossJoin(two)  # one row each
    return rows.withColumn("jaccard", F.col("shared") / F.greatest(F.col("first") + F.col("second") - F.col("shared"), F.lit(1)))


def compare_all(sets: dict[str, DataFrame], reference: str | None = None) -> DataFrame:
    """`compare` of every pair of named block sets, or of each with the reference: (method_a, method_b, ...)."""
    names = sorted(sets)
    chosen = [(reference, b) for b in names if b != reference] if reference else [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    parts = [compare(sets[a], sets[b]).withColumns({"method_a": F.lit(a), "method_b": F.lit(b)}) for a, b in chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boundaries(blocks: DataFrame) -> DataFrame:
    """Gaps between consecutive blocks of a chromosome."""
    own = Window.partitionBy("chr").orderBy("start")
    return blocks.select("chr", F.col("end").alias("left"), F.lead("start").over(own).alias("right")).where("right IS NOT NULL")


def summary(blocks: DataFrame) -> DataFrame:
    """(n_blocks, n_variants, mean_size, median_size, mean_bases, median_bases) of a block set."""
    bases = F.col("end") - F.col("start") + 1
    return blocks.agg(
        F.count("*").alias("n_blocks"), F.sum("n_variants").alias("n_variants"), F.avg("n_variants").alias("mean_size"), F.median("n_variants").alias("median_size"),
        F.avg(bases).alias("mean_bases"), F.median(bases).alias("median_bases"),
    )
