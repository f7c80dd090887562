"""Relationships of more samples than variants by their factor: K = A A' with A of samples by variants.

Nothing of samples by samples is formed: inverses and determinants go through matrices of the factor's
columns, so work and memory grow with the samples. The results are those of the full matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kinship, mixed

#: Samples whose calls one row brings to the driver.
BLOCK = 1024


#: Samples whose values a sum over samples holds as numbers at once.
ROWS = 8192


@dataclass(frozen=True)
class Levels:
    """A matrix whose columns have at most 256 values each, as one byte a value; slices of rows are matrices of numbers."""

    codes: np.ndarray
    levels: np.ndarray  # (columns, values)

    @staticmethod
    def of(x: np.ndarray) -> np.ndarray | Levels:
        """x itself where a column has more values, or where that is no smaller."""
        codes, levels = np.empty(x.shape, np.uint8), np.zeros((x.shape[1], 256))
        for k in range(x.shape[1]):
            own, at = np.unique(x[:, k], return_inverse=True)
            if len(own) > 256:
                return x
            codes[:, k], levels[k, : len(own)] = at, own
        found = Levels(codes, np.ascontiguousarray(levels[:, : int(codes.max(initial=0)) + 1]))
        return found if found.nbytes < x.nbytes else x

    @property
    def shape(self) -> tuple[int, int]:
        return self.codes.shape

    @property
    def nbytes(self) -> int:
        return self.codes.nbytes + self.levels.nbytes

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.levels[np.arange(len(self.levels))[None], self.codes[rows]]


@dataclass(frozen=True)
class Thin:
    """K = A A'."""

    factor: np.ndarray

    def __len__(self) -> int:
        return len(self.factor)

    def of(self, which: np.ndarray) -> Thin:
        """The relationship of some of the samples."""
        return Thin(self.factor[which])

    def dense(self) -> np.ndarray:
        return self.factor @ self.factor.T

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues above zero and their vectors, samples by rank."""
        vectors, values, _ = np.linalg.svd(self.factor, full_matrices=False)
        keep = values > 1e-10 * values.max(initial=0.0)
        return values[keep][::-1] ** 2, np.ascontiguousarray(vectors[:, keep][:, ::-1])


@dataclass(frozen=True)
class Projection:
    """base + L Q L', which multiplies columns from the left; base is a diagonal, or an object that multiplies."""

    base: object
    left: np.ndarray
    inner: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.left.nbytes

    def __matmul__(self, g: np.ndarray) -> np.ndarray:
        own = self.base[:, None] * g if isinstance(self.base, np.ndarray) else self.base @ g
        return own + self.left @ (self.inner @ (self.left.T @ g))


def relationship(cells: DataFrame, samples: list[int], kind: str = "vanraden", ploidy: int = 2) -> np.ndarray | Thin:
    """`kinship.relationship`, as its factor where there are fewer variants than samples. The calls come to the driver as one byte each where a variant has few values."""
    rows = kinship.encoded(cells, kind, ploidy).persist()
    found = _columns(rows, samples)
    if found is None:
        rows.unpersist()
        return kinship.relationship(cells, samples, kind, ploidy)
    norm = kinship._norm(rows).first()["norm"] or 0.0
    rows.unpersist()
    factor = found[1]
    factor /= math.sqrt(norm if norm > 1e-10 else 1.0)
    return Thin(factor)


def leave_one_out(cells: DataFrame, samples: list[int], by: str = "chr", kind: str = "vanraden", ploidy: int = 2) -> Iterator[tuple[object, np.ndarray | Thin]]:
    """(value, relationship) of `kinship.leave_one_out`, one at a time, as factors where there are fewer variants than samples: each is the whole factor less the columns left out."""
    rows = kinship.encoded(cells, kind, ploidy).persist()
    found = _columns(rows, samples)
    if found is None:
        rows.unpersist()
        yield from sorted(kinship.leave_one_out(cells, samples, by, kind, ploidy).items())
        return
    names, factor = found
    norms = {r[by]: r["norm"] for r in kinship._norm(rows, by).collect()}
    placed = rows.select("v_idx", by).distinct().collect()
    rows.unpersist()
    if len(placed) > len(names):  # a variant's calls have several values, so it is no column of one
        yield from sorted(kinship.leave_one_out(cells, samples, by, kind, ploidy).items())
        return
    of = {r["v_idx"]: r[by] for r in placed}
    values, total = np.array([of[v] for v in names.tolist()]), sum(norms.values())
    for c in sorted(norms):
        yield c, Thin(factor[:, values != c] / math.sqrt(max(total - norms[c], 1e-10)))


def _columns(rows: DataFrame, samples: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
    """The variants and their values, samples by variants, on the driver; None where there are no fewer variants than samples."""
    names = np.array([r["v_idx"] for r in rows.select("v_idx").distinct().orderBy("v_idx").limit(len(samples)).collect()], np.int64)
    if len(names) >= len(samples):
        return None
    order = np.array(sorted(samples), np.int64)
    if order.size * names.size * 8 > mixed.MOST_BYTES:
        raise ValueError(f"a factor of {order.size} samples and {names.size} variants is too large for the driver")
    blocks = rows.groupBy(F.floor(F.col("s_idx") / BLOCK).alias("b")).agg(F.collect_list(F.struct("v_idx", "s_idx", "x")).alias("c"))

    def dense(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                c = batch.column("c")[k].values
                who, at = np.unique(c.field("s_idx").to_numpy(), return_inverse=True)
                x = np.zeros((len(names), len(who)))
                x[np.searchsorted(names, c.field("v_idx").to_numpy()), at] = c.field("x").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (who.astype(np.int64).tobytes(), *kinship._coded(x))], ["s", "x", "levels"])

    factor = np.zeros((len(order), len(names)))
    for row in blocks.mapInArrow(dense, "s binary, x binary, levels binary").toLocalIterator():
        who = np.frombuffer(row["s"], np.int64)
        at = np.searchsorted(order, who)
        inside = (at < len(order)) & (order[np.minimum(at, len(order) - 1)] == who)
        factor[at[inside]] = kinship._decoded(row["x"], row["levels"], len(names), len(who)).T[inside]
    return names, factor


def spectrum(k: np.ndarray | Thin, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """`kinship.spectrum`; of a factor the axes with variance, and others without up to ``least`` of them."""
    if not isinstance(k, Thin):
        return kinship.spectrum(k)
    values, vectors = k.eigen()
    values, vectors = values[::-1], vectors[:, ::-1]
    if (short := min(least, len(k)) - len(values)) > 0:
        # unit vectors of samples, made orthogonal to the axes there are
        more = np.eye(len(k), min(len(k), least))
        for _ in range(2):
            more = more - vectors @ (vectors.T @ more)
        more = np.linalg.svd(more, full_matrices=False)[0][:, :short]
        values, vectors = np.concatenate([values, np.zeros(short)]), np.column_stack([vectors, more])
    return values, vectors


def axes(k: np.ndarray | Thin, *blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, spare): axes of K, then axes without variance that hold what is left of the blocks, and the number of axes in which K and the blocks are 0."""
    values, vectors = mixed.eigen(k)
    n, r = vectors.shape
    if r == n:
        return values, vectors, 0
    left = np.column_stack(blocks).astype(float)
    size = np.linalg.norm(left)
    for _ in range(2):
        left = left - vectors @ (vectors.T @ left)
    q, s, _ = np.linalg.svd(left, full_matrices=False)
    q = q[:, s > 1e-12 * size]
    return np.concatenate([values, np.zeros(q.shape[1])]), np.column_stack([vectors, q]), n - r - q.shape[1]


def weighted(z: np.ndarray, x: np.ndarray, w: np.ndarray, k: Thin, tau: float | None, dispersed: bool) -> tuple[float, float, np.ndarray, np.ndarray, Projection]:
    """What `glmm._weighted` gives for the full matrix."""
    n, c = x.shape
    root = np.sqrt(w)
    zs, xs = root * z, root[:, None] * x
    values, vectors = Thin(root[:, None] * k.factor).eigen()
    uz, ux = vectors.T @ zs, vectors.T @ xs
    zz, xz, xx = zs @ zs, xs.T @ zs, xs.T @ xs
    if tau is None:
        if dispersed:
            tau = mixed.best_ratio(lambda r: mixed.profile(zs, xs, values, vectors, False)(r)[0])
        else:

            def likelihood(t: float) -> float:
                shrink = 1 / (t * values + 1) - 1
                gram = xx + ux.T @ (shrink[:, None] * ux)
                right = xz + ux.T @ (shrink * uz)
                rest = zz + uz @ (shrink * uz) - right @ np.linalg.solve(gram, right)
                return -0.5 * (np.log1p(t * values).sum() + np.linalg.slogdet(gram)[1] + rest)

            tau = mixed.best_ratio(likelihood, -12.0, 5.0, 69)
            if likelihood(1e-8) >= likelihood(tau) - 1e-9:
                tau = 0.0
    shrink = 1 / (tau * values + 1) - 1
    gram = xx + ux.T @ (shrink[:, None] * ux)
    beta = np.linalg.solve(gram, xz + ux.T @ (shrink * uz))
    e = zs - xs @ beta
    r = e + vectors @ (shrink * (vectors.T @ e))
    phi = float(e @ r) / (n - c) if dispersed else 1.0
    u = tau * (k.factor @ (k.factor.T @ (root * r)))
    vectors *= root[:, None]
    ix = root[:, None] * xs + vectors @ (shrink[:, None] * ux)
    inner = np.zeros((len(values) + c,) * 2)
    inner[: len(values), : len(values)] = np.diag(shrink)
    inner[len(values) :, len(values) :] = -np.linalg.inv(gram)
    return tau, phi, beta, u, Projection(w / phi, np.column_stack([vectors, ix]), inner / phi)


@dataclass(frozen=True)
class HazardWeights:
    """The partial likelihood's information: expected events less what each risk set shares, by running sums in the order of time."""

    order: np.ndarray
    first: np.ndarray
    expected: np.ndarray
    risk: np.ndarray
    shared: np.ndarray

    def __matmul__(self, g: np.ndarray) -> np.ndarray:
        b = (self.risk[:, None] * g)[self.order]
        shared = self.shared[self.order][:, None]
        later = np.cumsum(b[::-1], axis=0)[::-1][self.first]
        before = np.vstack([np.zeros((1, b.shape[1])), np.cumsum(shared * b, axis=0)])[self.first]
        out = np.empty_like(b)
        out[self.order] = shared * later + before
        return self.expected[:, None] * g - self.risk[:, None] * out


def inverse_projection(weights: HazardWeights, design: np.ndarray, k: Thin, tau: float) -> Projection:
    """(W^-1 + tau K)^-1 with a design projected out, for weights that are no diagonal."""
    wa, wx = weights @ k.factor, weights @ design
    m = np.linalg.inv(np.eye(wa.shape[1]) + tau * (k.factor.T @ wa)) * tau
    m = (m + m.T) / 2
    ix = wx - wa @ (m @ (wa.T @ design))
    r, c = wa.shape[1], design.shape[1]
    inner = np.zeros((r + c, r + c))
    inner[:r, :r] = -m
    inner[r:, r:] = -np.linalg.pinv(design.T @ ix) if c else 0.0
    return Projection(weights, np.column_stack([wa, ix]), inner)


@dataclass(frozen=True)
class StackedProjection:
    """The projection of rows stacked by category, environment or trait, whose effects have a covariance with A A'."""

    weights: np.ndarray  # (k, k, n)
    factor: np.ndarray
    design: np.ndarray
    middle: np.ndarray
    cross: np.ndarray
    gram_inverse: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.factor.nbytes

    def compact(self) -> StackedProjection:
        """The same with one byte for each value of the factor where its columns have few, as it travels to the tasks."""
        return replace(self, factor=Levels.of(self.factor)) if isinstance(self.factor, np.ndarray) else self

    def forms(self, g: np.ndarray) -> np.ndarray:
        """g' P_ab g of columns, (k, k, columns); sums over ROWS samples at a time."""
        k, m = len(self.weights), g.shape[1]
        r, c = self.factor.shape[1], self.design.shape[1]
        af, ax, own = np.zeros((k, k * r, m)), np.zeros((k, k * c, m)), np.zeros((k, k, m))
        for at in range(0, len(g), ROWS):
            rows = slice(at, at + ROWS)
            factor, design, part = self.factor[rows], self.design[rows], g[rows]
            for a in range(k):
                for b in range(k):
                    if self.weights[a, b, rows].any():
                        wg = self.weights[a, b, rows][:, None] * part
                        af[b, a * r : (a + 1) * r] += factor.T @ wg
                        ax[b, a * c : (a + 1) * c] += design.T @ wg
                        own[a, b] += (part * wg).sum(0)
        d = [ax[b] - self.cross.T @ (self.middle @ af[b]) for b in range(k)]
        return np.stack([[own[a, b] - (af[a] * (self.middle @ af[b])).sum(0) - (d[a] * (self.gram_inverse @ d[b])).sum(0) for b in range(k)] for a in range(k)])


def _grid(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    q = len(weights)
    empty = np.zeros((left.shape[1], right.shape[1]))
    return np.block([[left.T @ (weights[i, j][:, None] * right) if weights[i, j].any() else empty for j in range(q)] for i in range(q)])


@dataclass(frozen=True)
class Solved:
    """A stacked model at given weights: the projection, effects of the design, P z by row, A' P z, and A' P_ab A."""

    projection: StackedProjection
    beta: np.ndarray
    r: np.ndarray
    q: np.ndarray
    within: np.ndarray


def solve(weights: np.ndarray, wz: np.ndarray, design: np.ndarray, k: Thin, sigma: np.ndarray) -> Solved:
    """z = X b + u + e for rows (trait, sample): cov(u) = sigma (x) A A', precision of e within a sample by ``weights`` (traits, traits, samples), wz = W z."""
    a, d = k.factor, len(weights)
    gram_a, cross = _grid(weights, a, a), _grid(weights, a, design)
    values, vectors = np.linalg.eigh((sigma + sigma.T) / 2)
    load = np.kron(vectors * np.sqrt(np.maximum(values, 0)), np.eye(a.shape[1]))
    middle = load @ np.linalg.solve(np.eye(len(load)) + load.T @ gram_a @ load, load.T)
    middle = (middle + middle.T) / 2
    gram = np.linalg.pinv(_grid(weights, design, design) - cross.T @ middle @ cross)
    az = (wz @ a).ravel()
    beta = (gram @ ((wz @ design).ravel() - cross.T @ (middle @ az))).reshape(d, -1)
    u = (middle @ (az - cross @ beta.ravel())).reshape(d, -1)
    r = wz - np.einsum("abi,bi->ai", weights, beta @ design.T + u @ a.T)
    left = cross - gram_a @ middle @ cross
    within = gram_a - gram_a @ middle @ gram_a - left @ gram @ left.T
    return Solved(StackedProjection(weights, a, design, middle, cross, gram), beta, r, r @ a, within)


def stacked(weights: np.ndarray, design: np.ndarray, k: Thin, tau: float) -> StackedProjection:
    return solve(weights, np.zeros(weights.shape[1:]), design, k, tau * np.eye(len(weights))).projection


def average_information(y: np.ndarray, x: np.ndarray, kernels: list[Thin], flags: list[np.ndarray], rounds: int = 100, tol: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray, Projection]:
    """(variances, log likelihood, P y, P) as `reml.average_information` finds them, of kernels by factors, of residuals of flagged samples, and of all.

    After one product of the columns of factors, design and trait for each set of equally flagged samples, everything is of the size of those columns.
    """
    n, c = x.shape
    m = np.column_stack([*(k.factor for k in kernels), x, y])
    widths = [k.factor.shape[1] for k in kernels]
    r = sum(widths)
    ends = np.cumsum([0, *widths])
    own = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    xs, at_y, p = slice(r, r + c), r + c, m.shape[1]
    code = sum((f.astype(int) << k for k, f in enumerate(flags)), np.zeros(n, int))
    sets, of = np.unique(code, return_inverse=True)
    counts = np.bincount(of).astype(float)
    grams = np.stack([m[of == e].T @ m[of == e] for e in range(len(sets))])
    member = np.array([[(s >> k) & 1 for s in sets] for k in range(len(flags))] + [[1] * len(sets)], float)
    q = len(kernels)
    s = np.full(q + len(member), float(np.var(y)) / (q + len(member)))

    def at(s: np.ndarray) -> dict:
        d = s[q:] @ member
        root = np.sqrt(np.repeat(s[:q], widths))
        g = np.einsum("e,eij->ij", 1 / d, grams)
        chol = np.linalg.cholesky(np.eye(r) + root[:, None] * g[:r, :r] * root[None])
        half = np.linalg.solve(chol, np.diag(root))
        middle = half.T @ half
        h = g - g[:, :r] @ middle @ g[:r]
        gram_inverse = np.linalg.inv(h[xs, xs])
        t = np.eye(p)
        t[:r] -= middle @ g[:r]
        inner = t[:, xs] @ gram_inverse @ t[:, xs].T
        inner[:r, :r] += middle
        projected = h - h[:, xs] @ gram_inverse @ h[xs]
        t = t - t[:, xs] @ gram_inverse @ h[xs]
        a = t[:, at_y]
        ll = -0.5 * (counts @ np.log(d) + 2 * np.log(np.diag(chol)).sum() + np.linalg.slogdet(h[xs, xs])[1] + projected[at_y, at_y] + (n - c) * math.log(2 * math.pi))
        ga = grams @ a / d[:, None] ** 2  # (sets, columns): M' of the parts of P y in each set, over d
        ky = [projected[o, at_y] for o in own]
        sets_trace = counts / d - np.einsum("eij,ij->e", grams, inner) / d**2
        sets_square = ga @ a
        score = np.array([-0.5 * (np.trace(projected[o, o]) - v @ v) for o, v in zip(own, ky, strict=True)] + list(-0.5 * (member @ (sets_trace - sets_square))))
        cross = np.diag(sets_square / d) - ga @ inner @ ga.T
        info = np.zeros((len(s), len(s)))
        for i, o in enumerate(own):
            for j, w in enumerate(own):
                info[i, j] = ky[i] @ projected[o, w] @ ky[j]
            info[q:, i] = info[i, q:] = member @ (ga @ t[:, o] @ ky[i])
        info[q:, q:] = member @ cross @ member.T
        return {"ll": ll, "score": score, "information": 0.5 * info, "d": d, "a": a, "inner": inner}

    found = at(s)
    for _ in range(rounds):
        step = np.linalg.lstsq(found["information"], found["score"], rcond=None)[0]
        em = s + 2 * s * s / n * found["score"]
        size = 1.0
        while size > 1e-4:
            new = s + size * step
            new = np.where(new > 0, new, np.maximum(em, 1e-8 * s.sum()))
            try:
                other = at(new)
            except np.linalg.LinAlgError:
                other = None
            if other and other["ll"] >= found["ll"] - 1e-10:
                break
            size /= 2
        else:
            new = np.maximum(em, 1e-10)
            other = at(new)
        moved, gain = np.abs(new - s).max() / s.sum(), other["ll"] - found["ll"]
        s, found = new, other
        if moved < tol or abs(gain) < 1e-9:
            break
    scale = 1 / found["d"][of]
    py = scale * (m @ found["a"])
    m *= scale[:, None]
    return s, float(found["ll"]), py, Projection(scale, np.ascontiguousarray(m[:, : r + c]), -found["inner"][: r + c, : r + c])
