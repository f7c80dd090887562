"""Multi-locus scans: the driver keeps a few covariate markers, Spark rescans the variants each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import mixed
from .packed import map_variants, pack


#: Cells worked on at once.
CELLS = 1 << 20
#: Samples of one packed row.
TILE = 1 << 16


def _rows(g: np.ndarray) -> list[slice]:
    """Slices of samples of some CELLS."""
    step = max(1, CELLS // max(1, g.shape[1]))
    return [slice(a, min(a + step, len(g))) for a in range(0, len(g), step)]


def score_linear(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Least-squares effect of each column after the design; a column inside the design's span has no p."""
    y, x = s["y"], s["x"]
    q, _ = np.linalg.qr(x)
    ry, inside = y - q @ (q.T @ y), q.T @ g
    whole, gg, gy = (np.zeros(g.shape[1]) for _ in range(3))
    for rows in _rows(g):
        rg = g[rows] - q[rows] @ inside
        whole += (g[rows] * g[rows]).sum(axis=0)
        gg += (rg * rg).sum(axis=0)
        gy += rg.T @ ry[rows]
    ok = gg > 1e-8 * np.maximum(whole, 1e-12)
    df = float(len(y) - x.shape[1] - 1)
    beta = np.where(ok, gy / np.where(ok, gg, 1.0), np.nan)
    s2 = np.maximum(ry @ ry - np.nan_to_num(beta) ** 2 * gg, 1e-300) / df
    se = np.sqrt(s2 / np.where(ok, gg, 1.0))
    return {"beta": beta, "se": np.where(ok, se, np.nan), "p": np.where(ok, specfun.f_sf(np.nan_to_num(beta / se) ** 2, 1.0, df), np.nan)}


def linear_scan(cells: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray) -> DataFrame:
    return map_variants(cells, samples, score_linear, {"y": y, "x": x}, "beta double, se double, p double")


def columns_of(cells: DataFrame, samples: list[int], variants: list[int]) -> np.ndarray:
    """Mean-imputed dosage columns of a few variants, for the driver."""
    if not variants:
        return np.zeros((len(samples), 0))
    wide = cells.where(F.col("v_idx").isin(variants)).toPandas().pivot(index="s_idx", columns="v_idx", values="dosage").reindex(sorted(samples))[variants]
    return wide.fillna(wide.mean()).to_numpy(float)


def _smallest(scan: DataFrame, k: int, threshold: float) -> pd.DataFrame:
    return scan.where(F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") <= threshold)).orderBy("p", "v_idx").limit(k).toPandas()


def _cut(cells: DataFrame, threshold: float | None) -> float:
    """The threshold, or 0.01 over the number of variants."""
    return threshold if threshold is not None else 0.01 / max(1, cells.select("v_idx").distinct().count())


def conditional_leads(cells: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, threshold: float = 5e-8, most: int = 5, kinship: np.ndarray | None = None) -> DataFrame:
    """Lead variants found one by one, each conditional on those before: (round, v_idx, beta, se, p).

    Calls are packed once for all rounds. With a kinship matrix each round is a mixed model whose
    null fit holds the leads found so far.
    """
    found: list[tuple] = []
    packed = pack(cells).persist()
    basis = mixed.eigen(kinship) if kinship is not None else None
    while len(found) < most:
        own = np.column_stack([x, columns_of(cells, samples, [f[1] for f in found])])
        scan = linear_scan(packed, samples, y, own) if basis is None else mixed.scan(packed, mixed.fit_eigen(y, own, *basis, sorted(samples)))
        top = _smallest(scan, 1, threshold)
        if not len(top):
            break
        r = top.iloc[0]
        found.append((len(found) + 1, int(r["v_idx"]), float(r["beta"]), float(r["se"]), float(r["p"])))
    packed.unpersist()
    return cells.sparkSession.createDataFrame(found, "round int, v_idx long, beta double, se double, p double")


def pruned(candidates: list[int], columns: np.ndarray, most: float = 0.7) -> list[int]:
    """Candidates in order of p without those correlated above ``most`` with one kept before."""
    kept: list[int] = []
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.nan_to_num(np.corrcoef(columns, rowvar=False))) if columns.shape[1] > 1 else np.ones((1, 1))
    for k in range(len(candidates)):
        if all(r[k, j] <= most for j in kept):
            kept.append(k)
    return [candidates[k] for k in kept]


def bic(y: np.ndarray, x: np.ndarray) -> float:
    n = len(y)
    rss = float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
    s2 = max(rss / (n - 1), 1e-300)
    return n * np.log(2 * np.pi) + n * np.log(s2) + rss / s2 + (x.shape[1] - 1) * np.log(n)


def _final(cells: DataFrame, packed: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, chosen: list[int]) -> DataFrame:
    """The scan with the chosen variants as covariates; each of these is tested given the others."""
    columns = columns_of(cells, samples, chosen)
    scan = linear_scan(packed, samples, y, np.column_stack([x, columns]))
    if not chosen:
        return scan
    rows = []
    for k, v in enumerate(chosen):
        found = score_linear(columns[:, [k]], {"y": y, "x": np.column_stack([x, np.delete(columns, k, axis=1)])})
        rows.append((int(v), *(float(found[c][0]) for c in ("beta", "se", "p"))))
    own = cells.sparkSession.createDataFrame(rows, "v_idx long, beta double, se double, p double")
    return scan.where(~F.col("v_idx").isin(chosen)).unionByName(own)


def blink(cells: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, threshold: float | None = None, most: int = 20, rounds: int = 10) -> tuple[DataFrame, list[int]]:
    """Rounds of scan, LD pruning of the hits and choice of their number by BIC, until the set stays; the last scan and the set. Calls are packed once."""
    chosen: list[int] = []
    threshold, packed = _cut(cells, threshold), pack(cells).persist()
    for _ in range(rounds):
        scan = linear_scan(packed, samples, y, np.column_stack([x, columns_of(cells, samples, chosen)]))
        hits = [int(v) for v in _smallest(scan, most, threshold)["v_idx"]]
        pool = list(dict.fromkeys(chosen + hits))
        if not pool:
            return scan, []
        columns = columns_of(cells, samples, pool)
        keep = pruned(pool, columns)
        ordered = columns[:, [pool.index(v) for v in keep]]
        scores = [bic(y, np.column_stack([x, ordered[:, :k]])) for k in range(len(keep) + 1)]
        new = keep[: int(np.argmin(scores))]
        if set(new) == set(chosen):
            break
        chosen = new
    return _final(cells, packed, samples, y, x, chosen), chosen


def farmcpu(cells: DataFrame, variants: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, bin_size: int = 10_000, most: int = 10, threshold: float | None = None, rounds: int = 10) -> tuple[DataFrame, list[int]]:
    """Fixed and random rounds: the best variant of each bin below the threshold becomes a covariate. Calls are packed once."""
    from .scan import top_per_bin

    chosen: list[int] = []
    threshold, packed = _cut(cells, threshold), pack(cells).persist()
    for _ in range(rounds):
        scan = linear_scan(packed, samples, y, np.column_stack([x, columns_of(cells, samples, chosen)]))
        best = top_per_bin(scan.where(~F.isnan("p") & (F.col("p") <= threshold)).join(variants.select("v_idx", "chr", "pos"), "v_idx"), bin_size, most).toPandas()
        pool = list(dict.fromkeys(chosen + [int(v) for v in best["v_idx"]]))
        new = pruned(pool, columns_of(cells, samples, pool)) if pool else []
        if set(new) == set(chosen):
            break
        chosen = new
    return _final(cells, packed, samples, y, x, chosen), chosen


def knockoffs(g: np.ndarray, seed: int = 0, out: np.ndarray | None = None) -> np.ndarray:
    """Second-order Gaussian copies of a block's columns (samples x variants), some samples at a time; ``out`` may be g itself."""
    rng = np.random.default_rng(seed)
    n, m = g.shape
    mean = g.mean(axis=0)
    sd = np.maximum(np.sqrt(sum(((g[rows] - mean) ** 2).sum(axis=0) for rows in _rows(g)) / n), 1e-9)
    products = np.zeros((m, m))
    for rows in _rows(g):
        z = (g[rows] - mean) / sd
        products += z.T @ z
    sigma = 0.95 * (products / n) + 0.05 * np.eye(m)
    s = float(np.clip(2 * np.linalg.eigvalsh(sigma)[0], 1e-6, 1.0))
    inverse = np.linalg.inv(sigma)
    cov = 2 * s * np.eye(len(sigma)) - s * s * inverse
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    root = (vectors * np.sqrt(np.maximum(values, 0))).T
    out = np.empty_like(g) if out is None else out
    for rows in _rows(g):
        z = (g[rows] - mean) / sd
        out[rows] = (z - s * z @ inverse + rng.standard_normal(z.shape) @ root) * sd + mean
    return out


def knockoff_statistics(cells: DataFrame, variants: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, block: int = 20_000, kinship: np.ndarray | None = None) -> DataFrame:
    """(v_idx, w): |z| of each variant less that of its knockoff, made block by block; under a mixed model if there is a kinship matrix.

    Calls come packed by variant and tile of samples; a task holds one matrix of a block.
    """
    placed = cells.where(F.col("dosage").isNotNull()).groupBy("v_idx", F.floor(F.col("s_idx") / TILE).alias("tile")).agg(F.collect_list(F.struct("s_idx", "dosage")).alias("x"))
    # a variant without calls stays
    placed = placed.unionByName(cells.select("v_idx").distinct().select("v_idx", F.lit(None).cast("bigint").alias("tile"), F.lit(None).cast(placed.schema["x"].dataType).alias("x")))
    placed = placed.join(variants.select("v_idx", "chr", F.floor(F.col("pos") / block).alias("block")), "v_idx").select("chr", "block", "v_idx", F.col("x.s_idx").alias("s"), F.col("x.dosage").alias("d"))
    spark = cells.sparkSession
    dealt = placed.repartition(8 * spark.sparkContext.defaultParallelism, "chr", "block").sortWithinPartitions("chr", "block", "v_idx")
    shared = spark.sparkContext.broadcast((np.array(sorted(samples)), y, x, mixed.fit_null(y, x, kinship, sorted(samples)) if kinship is not None else None))

    def statistics(names: list[int], parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        order, y, x, fit = shared.value
        g = np.full((len(order), len(names)), np.nan)
        while parts:
            column, who, d = parts.pop()
            row = np.minimum(np.searchsorted(order, who), len(order) - 1)
            inside = order[row] == who
            g[row[inside], column] = d[inside]
        for k in range(len(names)):  # missing calls at the variant's mean
            gone = np.isnan(g[:, k])
            g[gone, k] = g[~gone, k].mean() if not gone.all() else 0.0

        def score(m: np.ndarray) -> np.ndarray:
            found = score_linear(m, {"y": y, "x": x}) if fit is None else dict(zip(("beta", "se", "p"), mixed.score(fit, m), strict=True))
            return np.abs(np.nan_to_num(found["beta"] / found["se"]))

        own = score(g)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(own - score(knockoffs(g, names[0], g)))], ["v_idx", "w"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, parts = None, [], []
        for batch in stream:
            for r in range(batch.num_rows):
                key = batch.column("chr")[r].as_py(), batch.column("block")[r].as_py()
                if key != now and names:
                    yield statistics(names, parts)
                    names = []
                now, v = key, batch.column("v_idx")[r].as_py()
                if not names or names[-1] != v:
                    names.append(v)
                if batch.column("s")[r].is_valid:
                    parts.append((len(names) - 1, batch.column("s")[r].values.to_numpy().copy(), batch.column("d")[r].values.to_numpy().copy()))
        if names:
            yield statistics(names, parts)

    return dealt.mapInArrow(run, "v_idx long, w double")


def cross_fitted(cells: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, folds: int = 5, seed: int = 0) -> DataFrame:
    """Double machine learning: outcome and dosage are residualised out of fold, the slope's variance is robust; (v_idx, beta, se, p)."""
    fold = np.random.default_rng(seed).permutation(len(y)) % folds

    def residual(m: np.ndarray, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.empty_like(m)
        for f in range(folds):
            train, test = fold != f, fold == f
            out[test] = m[test] - x[test] @ np.linalg.lstsq(x[train], m[train], rcond=None)[0]
        return out

    def work(g: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        ry, rg = residual(s["y"][:, None], s["x"], s["fold"])[:, 0], residual(g, s["x"], s["fold"])
        gg = np.maximum((rg * rg).sum(axis=0), 1e-12)
        beta = rg.T @ ry / gg
        e = ry[:, None] - rg * beta
        se = np.sqrt((rg * rg * e * e).sum(axis=0)) / gg
        return {"beta": beta, "se": se, "p": np.clip(specfun.chi2_sf((beta / np.maximum(se, 1e-300)) ** 2, 1.0), specfun.FLOOR, 1)}

    return map_variants(cells, samples, work, {"y": y, "x": x, "fold": fold}, "beta double, se double, p double")


def haplotype_test(haplotypes: DataFrame, regions: DataFrame, samples: list[int], y: np.ndarray, x: np.ndarray, rare: float = 0.02) -> DataFrame:
    """F test of haplotype counts in each region; haplotypes: (v_idx, s_idx, copy, allele), regions: (region, v_idx)."""
    rows = haplotypes.join(regions, "v_idx").groupBy("region", "s_idx", "copy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v_idx", "allele"))), lambda a: a["allele"].cast("string")), "").alias("hap"))
    shared = haplotypes.sparkSession.sparkContext.broadcast((sorted(samples), y, x))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order, y, x = shared.value
        share = group["hap"].value_counts(normalize=True)
        group = group.assign(hap=group["hap"].where(group["hap"].map(share) >= rare, "OTHER"))
        counts = group.groupby(["s_idx", "hap"]).size().unstack(fill_value=0).reindex(order, fill_value=0)
        base = counts.sum().idxmax()
        h = counts.drop(columns=base).to_numpy(float)
        rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
        full = np.column_stack([x, h])
        k = int(np.linalg.matrix_rank(full) - np.linalg.matrix_rank(x)) if h.shape[1] else 0
        df = len(y) - x.shape[1] - k
        stat = ((rss(x) - rss(full)) / k) / (rss(full) / df) if k and df > 0 else 0.0
        return pd.DataFrame({"region": [group["region"].iloc[0]], "n_haplotypes": [counts.shape[1]], "f": [stat], "p": [float(specfun.f_sf(stat, float(k), float(df))) if k and df > 0 else 1.0]})

    return rows.groupBy("region").applyInPandas(run, "region string, n_haplotypes long, f double, p double")
