"""D' of unphased variants: haplotype frequencies by expectation maximisation, and likelihood limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: half the 95 % point of chi-square with one degree of freedom, the drop in log likelihood at the limits.
DROP = 1.9207
FLOOR = 1e-10


def _margins(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.maximum(counts.sum(axis=(1, 2)), 1.0)
    classes = np.arange(3) / 2
    p, q = counts.sum(axis=2) @ classes / n, counts.sum(axis=1) @ classes / n
    return n, np.clip(p, FLOOR, 1 - FLOOR), np.clip(q, FLOOR, 1 - FLOOR)


def haplotype_frequencies(counts: np.ndarray, rounds: int = 20, tol: float = 1e-8) -> np.ndarray:
    """Frequencies of the haplotypes 11, 10, 01, 00 from tables of genotype counts (pairs, 3, 3)."""
    n, p, q = _margins(counts)
    certain = 2 * counts[:, 2, 2] + counts[:, 2, 1] + counts[:, 1, 2]
    top = np.maximum(np.minimum(p, q), FLOOR)
    both = p * q
    for _ in range(rounds):
        coupled = both * np.maximum(1 - p - q + both, FLOOR)
        apart = np.maximum(p - both, FLOOR) * np.maximum(q - both, FLOOR)
        new = (certain + counts[:, 1, 1] * coupled / np.maximum(coupled + apart, FLOOR)) / (2 * n)
        new = np.minimum(np.maximum(new, FLOOR), top)
        moved = np.abs(new - both).max(initial=0.0)
        both = new
        if moved < tol:
            break
    found = np.stack([both, np.maximum(p - both, FLOOR), np.maximum(q - both, FLOOR), np.maximum(1 - p - q + both, FLOOR)], axis=1)
    return found / found.sum(axis=1, keepdims=True)


def dprime(freq: np.ndarray) -> np.ndarray:
    """|D'| of haplotype frequencies 11, 10, 01, 00."""
    p, q = freq[:, 0] + freq[:, 1], freq[:, 0] + freq[:, 2]
    d = freq[:, 0] - p * q
    most = np.where(d >= 0, np.minimum(p * (1 - q), (1 - p) * q), np.minimum(p * q, (1 - p) * (1 - q)))
    return np.where(most > 1e-12, np.minimum(np.abs(d) / np.maximum(most, 1e-12), 1.0), 0.0)


def limits(counts: np.ndarray, points: int = 201) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """D' of largest likelihood on a grid over [-1, 1], and the ends of what lies within DROP of it."""
    _, p, q = _margins(counts)
    # whole steps over the half, so that 0.3 is the number 0.3 and limits compare as written
    half = (points - 1) // 2
    grid = (np.arange(-half, half + 1) / half)[:, None]
    up, down = np.maximum(np.minimum(p * (1 - q), (1 - p) * q), FLOOR), np.maximum(np.minimum(p * q, (1 - p) * (1 - q)), FLOOR)
    d = grid * np.where(grid >= 0, up, down)
    h = np.maximum(np.stack([p * q + d, p * (1 - q) - d, (1 - p) * q - d, (1 - p) * (1 - q) + d]), FLOOR)
    # the genotype of a sample is the sum of two haplotypes drawn independently
    chance = np.zeros((3, 3, *d.shape))
    for a, (a1, a2) in enumerate(((1, 1), (1, 0), (0, 1), (0, 0))):
        for b, (b1, b2) in enumerate(((1, 1), (1, 0), (0, 1), (0, 0))):
            chance[a1 + b1, a2 + b2] += h[a] * h[b]
    likelihood = np.einsum("bij,ijgb->gb", counts, np.log(np.maximum(chance, FLOOR)))
    best = likelihood.argmax(axis=0)
    inside = likelihood >= likelihood.max(axis=0) - DROP
    return grid[best, 0], grid[inside.argmax(axis=0), 0], grid[2 * half - inside[::-1].argmax(axis=0), 0]


def pair_dprime(tables: DataFrame, step: int = 512) -> DataFrame:
    """(chr, i, j, pos_i, pos_j, n, dprime, likeliest, low, high) of `ld.genotype_tables`."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            for a in range(0, len(batch), step):
                own = batch.iloc[a : a + step]
                counts = np.stack(own["c"].to_numpy()).reshape(-1, 3, 3).astype(float)
                likeliest, low, high = limits(counts)
                yield own.drop(columns="c").assign(dprime=dprime(haplotype_frequencies(counts)), likeliest=likeliest, low=low, high=high)

    return tables.mapInPandas(run, "chr string, i long, j long, pos_i long, pos_j long, n long, dprime double, likeliest double, low double, high double")
