"""Mixed-model scan: null fit on the driver, variants scored in Spark."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from lociframe.functions import specfun

from .packed import map_variants

#: Bytes of eigenvectors that are broadcast at most.
MOST_BYTES = 2 << 30


@dataclass(frozen=True)
class NullFit:
    """REML fit; it is broadcast to the scan. The inverse of the scaled covariance is I + U diag(shrink) U'.

    U has all eigenvectors of the kinship matrix or, as a low-rank approximation, the leading ones.
    """

    samples: tuple[int, ...]
    vectors: np.ndarray
    shrink: np.ndarray
    design: np.ndarray
    py: np.ndarray
    gram_inverse: np.ndarray
    ratio: float
    sigma2_g: float
    sigma2_e: float
    log_likelihood: float

    def times(self, g: np.ndarray) -> np.ndarray:
        """The inverse covariance (up to sigma2_e) times columns."""
        return g + self.vectors @ (self.shrink[:, None] * (self.vectors.T @ g)) if g.ndim > 1 else self.times(g[:, None])[:, 0]


def eigen(kinship: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, not negative, and vectors; the ``rank`` largest if given. Of a factor (`thin`) those above zero."""
    n = len(kinship)
    if not isinstance(kinship, np.ndarray):
        values, vectors = kinship.eigen()
        return (values[-rank:], np.ascontiguousarray(vectors[:, -rank:])) if rank else (values, vectors)
    if (rank or n) * n * 8 > MOST_BYTES:
        raise ValueError(f"eigenvectors of {n} samples are too large to broadcast; give a rank below {MOST_BYTES // (8 * n)}")
    values, vectors = np.linalg.eigh((kinship + kinship.T) / 2)
    if rank:
        values, vectors = values[-rank:], np.ascontiguousarray(vectors[:, -rank:])
    return np.maximum(values, 0.0), vectors


def profile(y: np.ndarray, x: np.ndarray, values: np.ndarray, vectors: np.ndarray, projected: bool = True):
    """A function of the variance ratio that gives (REML log likelihood, shrink, x'Hx, Py, sigma2_e); Py only where it is ``projected``."""
    n, c = x.shape
    uy, ux = vectors.T @ y, vectors.T @ x
    yy, xy, xx = y @ y, x.T @ y, x.T @ x

    def at(ratio: float):
        shrink = 1 / (ratio * values + 1) - 1
        gram = xx + ux.T @ (shrink[:, None] * ux)
        hy = xy + ux.T @ (shrink * uy)
        beta = np.linalg.solve(gram, hy)
        s2 = max(float(yy + uy @ (shrink * uy) - hy @ beta) / (n - c), 1e-300)
        ll = -0.5 * ((n - c) * np.log(2 * np.pi * s2) + np.log1p(ratio * values).sum() + np.linalg.slogdet(gram)[1] + (n - c))
        if not projected:
            return ll, shrink, gram, None, s2
        residual = y - x @ beta
        return ll, shrink, gram, residual + vectors @ (shrink * (vectors.T @ residual)), s2

    return at


def best_ratio(likelihood, low: float = -10.0, high: float = 10.0, points: int = 81) -> float:
    """The ratio of largest likelihood: a grid on the log scale, then golden-section search."""
    grid = np.linspace(low, high, points)
    best = int(np.argmax([likelihood(np.exp(g)) for g in grid]))
    a, b = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        p, q = b - golden * (b - a), a + golden * (b - a)
        a, b = (a, q) if likelihood(np.exp(p)) >= likelihood(np.exp(q)) else (p, b)
    return float(np.exp((a + b) / 2))


def fit_null(y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], rank: int | None = None) -> NullFit:
    """Profile REML over the variance ratio, in the (leading) eigenvectors of the kinship matrix."""
    return fit_eigen(y, x, *eigen(kinship, rank), samples)


def fit_eigen(y: np.ndarray, x: np.ndarray, values: np.ndarray, vectors: np.ndarray, samples: list[int], ratio: float | None = None) -> NullFit:
    at, likelihood = profile(y, x, values, vectors), profile(y, x, values, vectors, False)
    ratio = best_ratio(lambda r: likelihood(r)[0]) if ratio is None else ratio
    ll, shrink, gram, py, s2 = at(ratio)
    return NullFit(tuple(samples), vectors, shrink, x, py, np.linalg.inv(gram), ratio, ratio * s2, s2, float(ll))


def _information(fit: NullFit, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g'Py and g'Pg (up to sigma2_e) of columns."""
    hg = fit.times(g)
    gx = hg.T @ fit.design
    return g.T @ fit.py, (g * hg).sum(axis=0) - np.einsum("ij,jk,ik->i", gx, fit.gram_inverse, gx)


def score(fit: NullFit, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, se and two-sided p of dosage columns (samples in the fit's order)."""
    n, c = fit.design.shape
    u, info = _information(fit, g)
    ok = info > 1e-10
    info = np.where(ok, info, 1.0)
    beta = np.where(ok, u / info, np.nan)
    # the residual variance at the alternative, as for an F test with n - c - 1 degrees of freedom
    null_rss = fit.sigma2_e * (n - c)
    s2 = np.maximum(null_rss - beta**2 * info, 1e-300) / (n - c - 1)
    se = np.sqrt(s2 / info)
    p = specfun.f_sf(np.where(ok, (beta / se) ** 2, 0.0), 1.0, float(n - c - 1))
    return beta, np.where(ok, se, np.nan), np.where(ok, p, np.nan)


def refit(g: np.ndarray, state: dict) -> dict[str, np.ndarray]:
    """beta, se, p and the variance ratio of each column with the ratio fitted anew with the column in the model. State: y, x, values, vectors."""
    y, x, values, vectors = (state[k] for k in ("y", "x", "values", "vectors"))
    n, c = x.shape
    out = np.full((4, g.shape[1]), np.nan)
    for k in range(g.shape[1]):
        design = np.column_stack([x, g[:, k]])
        if np.linalg.matrix_rank(design) < c + 1:
            continue
        at = profile(y, design, values, vectors, False)
        ratio = best_ratio(lambda r: at(r)[0], points=21)
        _, shrink, gram, _, s2 = at(ratio)
        hy = design.T @ y + (vectors.T @ design).T @ (shrink * (vectors.T @ y))
        inverse = np.linalg.inv(gram)
        beta, se = (inverse @ hy)[-1], np.sqrt(s2 * inverse[-1, -1])
        out[:, k] = beta, se, specfun.f_sf((beta / se) ** 2, 1.0, float(n - c - 1)), ratio
    return dict(zip(("beta", "se", "p", "ratio"), out, strict=True))


def scan(cells: DataFrame, fit: NullFit) -> DataFrame:
    """(v_idx, beta, se, p) for dense cells (v_idx, s_idx, dosage); missing calls get the variant's mean."""
    return map_variants(cells, list(fit.samples), _columns, fit, "beta double, se double, p double")


def scan_refit(cells: DataFrame, y: np.ndarray, x: np.ndarray, kinship: np.ndarray, samples: list[int], rank: int | None = None) -> DataFrame:
    """(v_idx, beta, se, p, ratio) with the variance components fitted anew for each variant."""
    values, vectors = eigen(kinship, rank)
    return map_variants(cells, samples, refit, {"y": y, "x": x, "values": values, "vectors": vectors}, "beta double, se double, p double, ratio double")


def _columns(g: np.ndarray, fit: NullFit) -> dict[str, np.ndarray]:
    return dict(zip(("beta", "se", "p"), score(fit, g), strict=True))


def set_tests(fit: NullFit, g: np.ndarray, weights: np.ndarray) -> dict[str, float]:
    """SKAT, burden and SKAT-O (minimum over mixtures, Bonferroni) of one set of variants."""
    s2 = fit.sigma2_e
    hg = fit.times(g)
    gx = hg.T @ fit.design
    pg = (g.T @ hg - gx @ fit.gram_inverse @ gx.T) / s2
    z = g.T @ fit.py / s2
    root = np.sqrt(weights)
    kernel = root[:, None] * pg * root[None]
    q_skat, q_burden = float((weights * z * z).sum()), float((root * z).sum() ** 2)
    out = {"q_skat": q_skat, "p_skat": specfun.davies_sf(q_skat, np.linalg.eigvalsh(kernel)), "p_burden": float(specfun.chi2_sf(q_burden / max(kernel.sum(), 1e-300), 1.0))}
    ps = []
    for rho in np.linspace(0, 1, 11):
        mix = (1 - rho) * np.eye(len(z)) + rho
        half = np.linalg.cholesky(mix + 1e-12 * np.eye(len(z)))
        ps.append(specfun.liu_sf((1 - rho) * q_skat + rho * q_burden, np.linalg.eigvalsh(half.T @ kernel @ half)))
    return out | {"p_skato": float(min(1.0, 11 * min(ps)))}


@dataclass(frozen=True)
class SparseFit:
    """A fit with a thresholded relationship matrix: samples fall into families, and the inverse covariance into their blocks."""

    samples: tuple[int, ...]
    blocks: tuple[tuple[np.ndarray, np.ndarray], ...]
    design: np.ndarray
    py: np.ndarray
    gram_inverse: np.ndarray
    ratio: float
    sigma2_g: float
    sigma2_e: float
    log_likelihood: float

    def times(self, g: np.ndarray) -> np.ndarray:
        out = np.array(g, float)
        for at, inverse in self.blocks:
            out[at] = inverse @ g[at]
        return out


class _Pairs:
    """Rows (i, j, k) of a table as flat arrays; refused as soon as the families they make are too large."""

    def __init__(self, rows: DataFrame, samples: list[int]) -> None:
        self.i, self.j, self.k = array("q"), array("q"), array("d")
        place, parent, size = {s: k for k, s in enumerate(samples)}, list(range(len(samples))), [1] * len(samples)
        held = len(samples)
        for i, j, k in rows.select("i", "j", "k").toLocalIterator():
            a, b = place[i], place[j]
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                a, b = (a, b) if size[a] >= size[b] else (b, a)
                held += 2 * size[a] * size[b]
                parent[b], size[a] = a, size[a] + size[b]
                if held * 8 > MOST_BYTES:
                    raise ValueError("families are too large to broadcast; raise the threshold of the relationship")
            self.i.append(i)
            self.j.append(j)
            self.k.append(k)

    def __iter__(self) -> Iterator[tuple[int, int, float]]:
        return zip(self.i, self.j, self.k, strict=True)


def families(pairs: Iterable[tuple[int, int, float]], samples: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, relationships) of each group of samples that pairs connect; pairs are (i, j, k) by sample, a sample with itself included."""
    place = {s: k for k, s in enumerate(samples)}
    parent = list(range(len(samples)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j, _ in pairs:
        a, b = sorted((root(place[i]), root(place[j])))
        parent[b] = a
    groups: dict[int, list[int]] = {}
    for k in range(len(samples)):
        groups.setdefault(root(k), []).append(k)
    at = {k: (g, n) for g, members in groups.items() for n, k in enumerate(members)}
    blocks = {g: np.eye(len(members)) for g, members in groups.items()}
    for i, j, value in pairs:
        (g, a), (_, b) = at[place[i]], at[place[j]]
        blocks[g][a, b] = blocks[g][b, a] = value
    return [(np.array(groups[g]), blocks[g]) for g in groups]


def fit_sparse(y: np.ndarray, x: np.ndarray, pairs: DataFrame, samples: list[int]) -> SparseFit:
    """Profile REML with a sparse relationship table (i, j, k), as `kinship.sparse_pairs` makes it: exact, family by family."""
    found = families(_Pairs(pairs, samples), samples)
    spectra = [(at, *np.linalg.eigh(k)) for at, k in found]
    spectra = [(at, np.maximum(v, 0), u) for at, v, u in spectra]
    n, c = x.shape
    values = np.concatenate([v for _, v, _ in spectra])
    uy, ux = np.concatenate([u.T @ y[at] for at, _, u in spectra]), np.concatenate([u.T @ x[at] for at, _, u in spectra])

    def likelihood(ratio: float) -> float:
        w = 1 / (ratio * values + 1)
        gram = ux.T @ (w[:, None] * ux)
        r = uy - ux @ np.linalg.solve(gram, ux.T @ (w * uy))
        s2 = max(float((w * r * r).sum()) / (n - c), 1e-300)
        return -0.5 * ((n - c) * np.log(2 * np.pi * s2) - np.log(w).sum() + np.linalg.slogdet(gram)[1] + (n - c))

    ratio = best_ratio(likelihood)
    blocks = tuple((at, (u * (1 / (ratio * v + 1))) @ u.T) for at, v, u in spectra)
    fit = SparseFit(tuple(samples), blocks, x, np.zeros(n), np.zeros((c, c)), ratio, 0.0, 0.0, likelihood(ratio))
    hx = fit.times(x)
    inverse = np.linalg.inv(x.T @ hx)
    residual = y - x @ (inverse @ (hx.T @ y))
    py = fit.times(residual)
    s2 = float(residual @ py) / (n - c)
    return SparseFit(tuple(samples), blocks, x, py, inverse, ratio, ratio * s2, s2, fit.log_likelihood)
