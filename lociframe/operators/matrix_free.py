"""Mixed models and leading axes without a relationship matrix: only its products with a few vectors.

K = X X' / norm, X being centred calls, so K V for many right-hand sides V is one pass over the stored
calls: each task adds up X (X' V) over its variants, and Spark adds the tasks' sums up by tiles of
samples. The driver holds a few vectors of a length in samples, never a matrix of samples by samples.

On these products stand Lanczos recurrences for many starts at once. The tridiagonal of a start y
gives y' f(K) y, and with the basis f(K) y, for every function f at no further pass: so one
recurrence serves all variance ratios. The log determinant in REML is the mean of such forms over
random signs (or their exact sum over unit vectors, where there are no more samples than probes).

Where there are fewer variants than samples, one pass gives X'X and X' with the starts, and the
recurrences run in the axes of K, in vectors of a length in variants: the same tridiagonals, and what
comes to the driver does not grow with the passes (`Axes`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import specfun

from . import packed
from .graph import ensure_checkpoints
from .mixed import MOST_BYTES, best_ratio

#: Numbers of a tile of a task's sums.
TILE_VALUES = 1 << 14


@dataclass(frozen=True)
class Calls:
    """Calls (v_idx, g) stored as one byte a sample, the samples in order, and the divisor of the relationship."""

    table: DataFrame
    samples: tuple[int, ...]
    ploidy: int
    norm: float


def stored_calls(cells: DataFrame, samples: list[int], ploidy: int = 2, path: str | None = None) -> Calls:
    """Write cells (v_idx, s_idx, dosage) for repeated passes, into the shared folder unless a path is given; or take a table (v_idx, g) as `packed.store` wrote it."""
    order = tuple(sorted(samples))
    table = cells
    if "g" not in cells.columns:
        spark = cells.sparkSession
        if path is None:
            ensure_checkpoints(spark)
            path = f"{spark.sparkContext.getCheckpointDir()}/calls-{uuid.uuid4().hex}"
        packed.store(cells, list(order), path)
        table = spark.read.parquet(path)

    def norms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for x, p in _centred(stream, len(order), ploidy):
            total += float((ploidy * p * (1 - p)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["norm"])

    return Calls(table, order, ploidy, max(float(table.mapInArrow(norms, "norm double").agg(F.sum("norm")).first()[0] or 0.0), 1e-10))


def _centred(stream: Iterator[pa.RecordBatch], n: int, ploidy: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of centred calls (samples by variants) and allele frequencies; a missing call is at the mean."""
    step = max(1, packed.BATCH_CELLS // max(1, n))
    for batch in stream:
        for a in range(0, batch.num_rows, step):
            g = packed._dense(batch.slice(a, step), n)
            mean = g.mean(axis=0)
            yield g - mean, mean / ploidy


def times(calls: Calls, v: np.ndarray) -> np.ndarray:
    """K v for all columns of v, in one pass over the calls."""
    n, r = v.shape
    if v.nbytes > MOST_BYTES:
        raise ValueError(f"{r} vectors of {n} samples are too large to broadcast")
    shared = calls.table.sparkSession.sparkContext.broadcast(v)
    tile, ploidy = max(1, TILE_VALUES // r), calls.ploidy

    def products(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for x, _ in _centred(stream, n, ploidy):
            own = x @ (x.T @ shared.value)
            out = own if out is None else out + own
        if out is not None:
            parts = [out[a : a + tile].tobytes() for a in range(0, n, tile)]
            for a in range(0, len(parts), 64):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(a + 64, len(parts)))), pa.array(parts[a : a + 64], pa.binary())], ["tile", "part"])

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for t, part in zip(batch.column("tile").to_pylist(), batch.column("part").to_pylist(), strict=True):
                own = np.frombuffer(part)
                sums[t] = sums[t] + own if t in sums else own
        for t, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([own.tobytes()], pa.binary())], ["tile", "part"])

    form = "tile bigint, part binary"
    out = np.zeros((n, r))
    for row in calls.table.mapInArrow(products, form).repartition("tile").mapInArrow(added, form).collect():  # n x r numbers
        a = row["tile"] * tile
        out[a : a + tile] = np.frombuffer(row["part"]).reshape(-1, r)
    shared.destroy()
    return out / calls.norm


@dataclass(frozen=True)
class Lanczos:
    """Bases (steps, n, starts) and tridiagonals of recurrences for several starts, whose lengths are given."""

    basis: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    length: np.ndarray

    def quadratic(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """b' f(K) b of each start."""
        return self.length**2 * (self.weights**2 * f(self.values)).sum(axis=1)

    def applied(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """f(K) b of each start as columns."""
        small = self.length[:, None] * np.einsum("rik,rk->ri", self.vectors, f(self.values) * self.weights)
        return np.einsum("inr,ri->nr", self.basis, small)


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, steps: int) -> Lanczos:
    """One recurrence for each column, all in the same passes, orthogonalised in full; a finished one rests at zero."""
    n, r = starts.shape
    steps = min(steps, n)
    if steps * starts.nbytes > 4 * MOST_BYTES:
        raise ValueError("the bases of these recurrences are too large for the driver; take fewer probes or steps")
    length = np.linalg.norm(starts, axis=0)
    q = np.where(length > 0, starts / np.where(length > 0, length, 1.0), 0.0)
    basis, diagonal, beside = [q], np.zeros((r, steps)), np.zeros((r, steps))
    for k in range(steps):
        w = multiply(basis[-1])
        diagonal[:, k] = (w * basis[-1]).sum(axis=0)
        scale = np.linalg.norm(w, axis=0)
        for _ in range(2):
            for b in basis:
                w = w - b * (b * w).sum(axis=0)
        if k + 1 == steps:
            break
        size = np.linalg.norm(w, axis=0)
        live = size > 1e-10 * np.maximum(scale, 1e-300)
        beside[:, k] = np.where(live, size, 0.0)
        if not live.any():
            break
        basis.append(np.where(live, w / np.where(live, size, 1.0), 0.0))
    used = len(basis)
    t = np.zeros((r, used, used))
    at = np.arange(used)
    t[:, at, at] = diagonal[:, :used]
    t[:, at[1:], at[:-1]] = t[:, at[:-1], at[1:]] = beside[:, : used - 1]
    values, vectors = np.linalg.eigh(t)
    return Lanczos(np.stack(basis), np.maximum(values, 0.0), vectors[:, 0], vectors, length)


def leading_axes(calls: Calls, count: int, extra: int = 10, rounds: int = 12, tolerance: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of K and their vectors, from a block Krylov space that grows by a pass until the values rest."""
    n = len(calls.samples)
    count = min(count, n)
    width = min(n, count + extra)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    basis, image, last = np.zeros((n, 0)), np.zeros((n, 0)), None
    for _ in range(rounds):
        block = block - basis @ (basis.T @ block)
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-12 * max(np.abs(r).max(), 1e-300)]
        if not block.shape[1]:
            break
        own = times(calls, block)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, own])
        values, small = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values = values[::-1][:count]
        if last is not None and len(last) == len(values) and np.abs(values - last).max() <= tolerance * max(values[0], 1e-300):
            break
        last, block = values, own
        if basis.shape[1] + width > n:
            block = np.linalg.qr(np.column_stack([basis, np.random.default_rng(seed + 1).standard_normal((n, n - basis.shape[1]))]))[0][:, basis.shape[1] :]
    return np.maximum(values, 0.0), basis @ small[:, ::-1][:, :count]


#: Variants up to which the products of all pairs come to the driver: 134 MB.
MOST_VARIANTS = 4096


@dataclass(frozen=True)
class Axes:
    """Axes in which K is diagonal, for starts b of a length in samples: ``values`` and then a 0 for each axis of what K leaves of the starts.

    ``starts`` are the coordinates of b; X ``load`` are the axes where K is not 0, load's rows being the variants at their ``place``.
    """

    values: np.ndarray
    starts: np.ndarray
    load: np.ndarray
    place: dict[int, int]


def _moments(calls: Calls, b: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """The variants' places, X'X and X'b: the calls pass to tasks by tiles of samples, whose products add up."""
    n, r = b.shape
    names = sorted(x["v_idx"] for x in calls.table.select("v_idx").collect())  # fewer than MOST_VARIANTS
    place, m = {v: k for k, v in enumerate(names)}, len(names)
    tile, parts = max(1, min(n, packed.BATCH_CELLS // max(1, m))), calls.table.sparkSession.sparkContext.defaultParallelism
    shared = calls.table.sparkSession.sparkContext.broadcast(b)

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                g = np.frombuffer(batch.column("g")[k].as_buffer(), np.uint8)
                known = g[g != 255]
                mean, blobs = float(known.mean()) if len(known) else 0.0, [g[a : a + tile].tobytes() for a in range(0, n, tile)]
                count = len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(count)), pa.array([batch.column("v_idx")[k].as_py()] * count), pa.array([mean] * count), pa.array(blobs, pa.binary())], ["tile", "v_idx", "mean", "g"]
                )

    def products(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xb = np.zeros((m, m)), np.zeros((m, r))
        now, x = None, None

        def add() -> None:
            own = shared.value[now * tile : now * tile + x.shape[1]]
            np.add(xx, x @ x.T, out=xx)
            np.add(xb, x @ own, out=xb)

        for batch in stream:
            for k in range(batch.num_rows):
                t = batch.column("tile")[k].as_py()
                if t != now:
                    if now is not None:
                        add()
                    now, x = t, np.zeros((m, min(n, (t + 1) * tile) - t * tile))
                at, mu = place[batch.column("v_idx")[k].as_py()], batch.column("mean")[k].as_py()
                g = np.frombuffer(batch.column("g")[k].as_buffer(), np.uint8)
                x[at] = np.where(g == 255, 0.0, g - mu)
        if now is not None:
            add()
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (xx, xb)], ["xx", "xb"])

    tiles = calls.table.mapInArrow(cut, "tile bigint, v_idx bigint, mean double, g binary")
    tiles = tiles.repartition(min(parts, max(1, -(-n // tile))), "tile").sortWithinPartitions("tile")
    xx, xb = np.zeros((m, m)), np.zeros((m, r))
    for row in tiles.mapInArrow(products, "xx binary, xb binary").toLocalIterator():  # at most one for each core
        xx += np.frombuffer(row["xx"]).reshape(m, m)
        xb += np.frombuffer(row["xb"]).reshape(m, r)
    shared.destroy()
    return place, xx, xb


def axes(calls: Calls, b: np.ndarray, shared: int) -> Axes:
    """The axes for starts b, of which the first ``shared`` keep their products with each other; each of the rest keeps its own length."""
    place, xx, xb = _moments(calls, b)
    values, vectors = np.linalg.eigh((xx + xx.T) / 2)
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    values, load = values[keep], vectors[:, keep] / np.sqrt(values[keep])
    inside = load.T @ xb
    first = b[:, :shared]
    left = first.T @ first - inside[:, :shared].T @ inside[:, :shared]
    w, u = np.linalg.eigh((left + left.T) / 2)
    outside = np.zeros((max(1, shared), b.shape[1]))
    outside[:shared, :shared] = np.sqrt(np.maximum(w, 0.0))[:, None] * u.T
    outside[0, shared:] = np.sqrt(np.maximum((b[:, shared:] ** 2).sum(axis=0) - (inside[:, shared:] ** 2).sum(axis=0), 0.0))
    return Axes(np.concatenate([values / calls.norm, np.zeros(len(outside))]), np.vstack([inside, outside]), load, place)


def combined(calls: Calls, weights: np.ndarray, place: dict[int, int]) -> np.ndarray:
    """X weights, one number a sample, in one pass: ``weights`` has one for each variant."""
    n = len(calls.samples)
    found = np.zeros(n)
    shared, ploidy = calls.table.sparkSession.sparkContext.broadcast((weights, place)), calls.ploidy

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = shared.value
        total = None
        for batch in stream:
            first = 0
            for x, _ in _centred(iter([batch.select(["g"])]), n, ploidy):
                w = own[[at[v.as_py()] for v in batch.column("v_idx")[first : first + x.shape[1]]]]
                first += x.shape[1]
                total = x @ w if total is None else total + x @ w
        if total is not None:
            for a in range(0, n, TILE_VALUES):
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([total[a : a + TILE_VALUES].tobytes()], pa.binary())], ["tile", "part"])

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in stream:
            for t, part in zip(batch.column("tile").to_pylist(), batch.column("part").to_pylist(), strict=True):
                totals[t] = totals[t] + np.frombuffer(part) if t in totals else np.frombuffer(part)
        for t, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([part.tobytes()], pa.binary())], ["tile", "part"])

    form = "tile bigint, part binary"
    for row in calls.table.mapInArrow(sums, form).repartition("tile").mapInArrow(added, form).toLocalIterator():  # n numbers
        part = np.frombuffer(row["part"])
        found[row["tile"] : row["tile"] + len(part)] = part
    shared.destroy()
    return found


@dataclass(frozen=True)
class FreeFit:
    """A REML fit without the inverse covariance; ``gamma`` is the mean share of a variant's residual square that the inverse leaves."""

    samples: tuple[int, ...]
    design: np.ndarray
    py: np.ndarray
    gram_inverse: np.ndarray
    ratio: float
    sigma2_g: float
    sigma2_e: float
    log_likelihood: float
    residual: float
    gamma: float
    gamma_spread: float


def fit_null(y: np.ndarray, x: np.ndarray, calls: Calls, probes: int = 30, steps: int = 50, calibration: int = 30, seed: int = 0) -> FreeFit:
    """Profile REML over the variance ratio; residual is the largest share of a right-hand side that the solves leave.

    ``steps`` passes give everything but the residual and gamma, which take one and ``steps`` more.
    gamma comes from ``calibration`` variants of smallest hash that vary.
    """
    n, c = x.shape
    rng = np.random.default_rng(seed)
    exact = n <= probes
    signs = np.eye(n) if exact else rng.choice([-1.0, 1.0], (n, probes))
    g = _sampled(calls, calibration)
    variants = calls.table.limit(min(n, MOST_VARIANTS + 1)).count()
    own, starts = None, [np.column_stack([y, x, signs]), g]
    multiply = lambda v: times(calls, v)
    if variants < n and variants <= MOST_VARIANTS:
        # all that follows is in the axes, but for py
        own = axes(calls, np.column_stack([y, x, g, signs]), 1 + c + g.shape[1])
        first, last = 1 + c, 1 + c + g.shape[1]
        starts = [np.delete(own.starts, slice(first, last), axis=1), own.starts[:, first:last]]
        multiply = lambda v: own.values[:, None] * v
    run = lanczos(multiply, starts[0], steps)
    of = lambda k: Lanczos(run.basis[:, :, k], run.values[k], run.weights[k], run.vectors[k], run.length[k])
    fixed, random = of(slice(0, 1 + c)), of(slice(1 + c, None))
    left, right = starts[0][:, 0], starts[0][:, 1 : 1 + c]  # y and x, or their coordinates

    def at(ratio: float):
        solved = fixed.applied(lambda d: 1 / (ratio * d + 1))
        hy, hx = solved[:, 0], solved[:, 1:]
        gram = (right.T @ hx + hx.T @ right) / 2
        beta = np.linalg.solve(gram, right.T @ hy)
        s2 = max(float(left @ hy - (right.T @ hy) @ beta) / (n - c), 1e-300)
        trace = random.quadratic(lambda d: np.log1p(ratio * d)).sum() * (1.0 if exact else 1.0 / probes)
        ll = -0.5 * ((n - c) * np.log(2 * np.pi * s2) + trace + np.linalg.slogdet(gram)[1] + (n - c))
        return ll, beta, gram, s2, solved

    ratio = best_ratio(lambda r: at(r)[0])
    ll, beta, gram, s2, solved = at(ratio)
    wanted = np.column_stack([left, right])
    rest = wanted - solved - ratio * multiply(solved)
    residual = float((np.linalg.norm(rest, axis=0) / np.maximum(np.linalg.norm(wanted, axis=0), 1e-300)).max())
    inverse, hx = np.linalg.inv(gram), solved[:, 1:]
    gamma, spread = 1.0, 0.0
    if g.shape[1]:
        hg = lanczos(multiply, starts[1], steps).applied(lambda d: 1 / (ratio * d + 1))
        gx = hx.T @ starts[1]
        info = (starts[1] * hg).sum(axis=0) - np.einsum("ij,ik,kj->j", gx, inverse, gx)
        plain = ((g - x @ np.linalg.lstsq(x, g, rcond=None)[0]) ** 2).sum(axis=0)
        ok = plain > 1e-8
        if ok.any():
            share = info[ok] / plain[ok]
            gamma, spread = float(share.mean()), float(share.std())
    py = solved[:, 0] - hx @ beta
    if own is not None:
        # outside the axes of K the inverse leaves what is there; inside, the axes are sums of variants
        plain, rank = left - right @ beta, own.load.shape[1]
        py = y - x @ beta + combined(calls, own.load @ (py - plain)[:rank], own.place)
    return FreeFit(calls.samples, x, py, inverse, ratio, ratio * s2, s2, float(ll), residual, gamma, spread)


def _sampled(calls: Calls, count: int) -> np.ndarray:
    """Centred calls of ``count`` variants of smallest hash that vary, as columns."""
    rows = calls.table.orderBy(F.xxhash64("v_idx"), "v_idx").limit(2 * count).select("g").toArrow()
    found = [x for batch in rows.to_batches() for x, _ in _centred([batch], len(calls.samples), calls.ploidy)]
    g = np.column_stack(found) if found else np.zeros((len(calls.samples), 0))
    return g[:, (g * g).sum(axis=0) > 1e-8][:, :count]


def score(g: np.ndarray, fit: FreeFit) -> dict[str, np.ndarray]:
    """beta, se and p of dosage columns: the score is exact, its variance gamma times that of a fit without relationship."""
    n, c = fit.design.shape
    q = np.linalg.qr(fit.design)[0]
    info = fit.gamma * np.maximum((g * g).sum(axis=0) - ((q.T @ g) ** 2).sum(axis=0), 0.0)
    ok = info > 1e-8
    beta = np.where(ok, (g.T @ fit.py) / np.where(ok, info, 1.0), np.nan)
    s2 = np.maximum(fit.sigma2_e * (n - c) - beta**2 * info, 1e-300) / (n - c - 1)
    se = np.sqrt(s2 / np.where(ok, info, 1.0))
    p = specfun.f_sf(np.where(ok, (beta / se) ** 2, 0.0), 1.0, float(n - c - 1))
    return {"beta": beta, "se": np.where(ok, se, np.nan), "p": np.where(ok, p, np.nan)}


def scan(calls: Calls, fit: FreeFit) -> DataFrame:
    """(v_idx, beta, se, p) of all stored variants."""
    return packed.map_variants(calls.table, list(fit.samples), score, fit, "beta double, se double, p double")
