"""LD pairs, D' and block methods against plain loops on a small chromosome."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from lociframe.operators import blocks, dprime, ld


@pytest.fixture(scope="module")
def panel():
    """60 samples, 24 variants in runs that are copied with errors."""
    rng = np.random.default_rng(1)
    n, m = 60, 24
    g = np.zeros((n, m))
    for a in range(0, m, 6):
        own = rng.binomial(2, 0.4, n)
        for k in range(a, a + 6):
            flip = rng.random(n) < 0.08 * (k - a)
            g[:, k] = np.where(flip, rng.binomial(2, 0.4, n), own)
    return g, np.arange(m) * 1000 + 1


@pytest.fixture(scope="module")
def tables(spark, panel):
    g, pos = panel
    calls = spark.createDataFrame([(v, s, float(g[s, v])) for v in range(g.shape[1]) for s in range(len(g))], "v_idx long, s_idx long, dosage double")
    variants = spark.createDataFrame([(v, "1", int(p)) for v, p in enumerate(pos)], "v_idx long, chr string, pos long")
    return calls, variants


def counts(a, b):
    out = np.zeros((3, 3))
    np.add.at(out, (a.astype(int), b.astype(int)), 1)
    return out


def test_tiles_of_samples_give_the_same_pairs(tables, panel):
    g, _ = panel
    for tile in (7, 1000):
        got = {(r.i, r.j): (r.n, r.r) for r in ld.pair_correlations(*tables, 5000, tile).collect()}
        assert len(got) == sum(1 for a, b in itertools.combinations(range(24), 2) if b - a <= 5)
        assert all(n == 60 and r == pytest.approx(np.corrcoef(g[:, a], g[:, b])[0, 1]) for (a, b), (n, r) in got.items())
        told = {(r.i, r.j): np.array(r.c).reshape(3, 3) for r in ld.genotype_tables(*tables, 5000, tile).collect()}
        assert all((c == counts(g[:, a], g[:, b])).all() for (a, b), c in told.items())


def test_dprime_and_limits(panel):
    g, _ = panel
    for a, b in ((0, 1), (0, 5), (2, 20)):
        c = counts(g[:, a], g[:, b])[None]
        p, q = g[:, a].mean() / 2, g[:, b].mean() / 2

        def chance(d):
            h = np.maximum([p * q + d, p * (1 - q) - d, (1 - p) * q - d, (1 - p) * (1 - q) + d], 1e-10)
            out = np.zeros((3, 3))
            for (x1, x2), hx in zip(((1, 1), (1, 0), (0, 1), (0, 0)), h):
                for (y1, y2), hy in zip(((1, 1), (1, 0), (0, 1), (0, 0)), h):
                    out[x1 + y1, x2 + y2] += hx * hy
            return out

        grid = np.arange(-100, 101) / 100
        scale = [max(min(p * (1 - q), (1 - p) * q), 1e-10) if x >= 0 else max(min(p * q, (1 - p) * (1 - q)), 1e-10) for x in grid]
        like = np.array([(c[0] * np.log(np.maximum(chance(x * s), 1e-10))).sum() for x, s in zip(grid, scale)])
        inside = grid[like >= like.max() - 1.9207]
        best, low, high = dprime.limits(c)
        assert (best[0], low[0], high[0]) == pytest.approx((grid[like.argmax()], inside[0], inside[-1]))
        freq = dprime.haplotype_frequencies(c, 500, 1e-14)
        assert freq.sum() == pytest.approx(1) and dprime.dprime(freq)[0] == pytest.approx(abs(best[0]), abs=0.011)


def band(panel, window=10_000):
    g, pos = panel
    rows = []
    for a, b in itertools.combinations(range(g.shape[1]), 2):
        if pos[b] - pos[a] <= window:
            c = counts(g[:, a], g[:, b])[None]
            _, low, high = dprime.limits(c)
            rows.append((a, b, np.corrcoef(g[:, a], g[:, b])[0, 1], dprime.dprime(dprime.haplotype_frequencies(c))[0], low[0], high[0]))
    pairs = pd.DataFrame(rows, columns=["i", "j", "r", "dprime", "low", "high"])
    return blocks.Band(pd.DataFrame({"v_idx": range(len(pos)), "pos": pos}), pairs, g.T), {(a, b): tuple(r) for a, b, *r in rows}


def test_spine_gabriel_big_ld_by_loops(panel):
    own, told = band(panel)
    m = own.m

    def ok_spine(a, b):
        return all(told.get((k, j), (0, 0))[1] >= 0.8 for j in range(a + 1, b + 1) for k in range(a, j))

    want, a = [], 0
    while a < m:
        b = a
        while b + 1 < m and ok_spine(a, b + 1):
            b += 1
        if b > a:
            want.append((a, b))
        a = b + 1
    assert blocks.spine(own) == want and want

    def greedy(candidates):
        free, out = [True] * m, []
        for a, b in candidates:
            if all(free[a : b + 1]):
                out.append((a, b))
                free[a : b + 1] = [False] * (b - a + 1)
        return sorted(out)

    found = []
    for a, b in itertools.combinations(range(m), 2):
        if (a, b) not in told:
            continue
        inner = [told[k, j] for k, j in itertools.combinations(range(a, b + 1), 2)]
        strong, weak = sum(x[2] > 0.5 and x[3] > 0.9 for x in inner), sum(x[3] < 0.85 for x in inner)
        informative = sum((x[2] > 0.5 and x[3] > 0.9) or x[3] < 0.85 for x in inner)
        if informative and strong >= 0.8 * informative and weak < 0.2 * informative:
            found.append((b - a, a))
    want = greedy([(a, a + n) for n, a in sorted(found, reverse=True)])
    assert blocks.gabriel(own, 0.5, 0.9, 0.85, 0.8, 0.2) == want and want
    means = {}
    for a, b in itertools.combinations(range(m), 2):
        if (a, b) in told:
            means[a, b] = np.mean([told[k, j][0] ** 2 for k, j in itertools.combinations(range(a, b + 1), 2)])
    want = greedy([ab for _, ab in sorted((-(ab[1] - ab[0] + 1) * x, ab) for ab, x in means.items() if x >= 0.3)])
    assert blocks.big_ld(own, 0.3) == want and want


def test_partitions_by_enumeration(panel):
    g, pos = panel
    small, _ = band((g[:, :9], pos[:9]))

    def splits(n, least, most):
        if n == 0:
            yield []
        for k in range(least, min(most, n) + 1):
            for rest in splits(n - k, least, most):
                yield [*rest, (n - k, n - 1)]

    def patterns(a, b):
        _, c = np.unique(g[:, a : b + 1], axis=0, return_counts=True)
        return (c >= 3).sum() + 2.0

    best = min(sum(patterns(a, b) for a, b in s) for s in splits(9, 2, 5))
    got = blocks.dp(small, penalty=2.0, most=5, frequent=0.05)
    assert sum(patterns(a, b) for a, b in got) == best

    def value(a, b):
        e = np.linalg.eigvalsh(small.square("r2", a, b))
        return e[-1] / e.sum() - 0.1 * math.log(max(e[-1] / max(e[0], 1e-10), 1))

    assert sum(value(a, b) for a, b in blocks.aligned(small, most=5)) == pytest.approx(max(sum(value(a, b) for a, b in s) for s in splits(9, 2, 5)))
    signal = np.array([1.0, 1.2, 0.9, 3.0, 3.1, 2.9, 3.2])
    cost = lambda s: sum(((signal[a : b + 1] - signal[a : b + 1].mean()) ** 2).sum() + 0.5 for a, b in s)
    assert cost(blocks.changepoint(signal, 0.5, 2)) == pytest.approx(min(cost(s) for s in splits(7, 2, 7)))


def test_graphs(panel):
    own, told = band(panel)
    near = {k: {k} for k in range(own.m)}
    for (a, b), x in told.items():
        if x[0] ** 2 > 0.3:
            joined = near[a] | near[b]
            for k in joined:
                near[k] = joined
    assert sorted(map(tuple, blocks.graph_components(own, 0.3))) == sorted({tuple(sorted(s)) for s in near.values()})
    square = own.square("r2", 0, own.m - 1)
    assert np.allclose(blocks.laplacian(square).sum(axis=1), 0) and abs(np.linalg.eigvalsh(blocks.laplacian(square, True))[0]) < 1e-9
    clusters = blocks.spectral(square, 4, 2)
    assert sorted(map(tuple, clusters)) == [tuple(range(a, a + 6)) for a in range(0, 24, 6)]
    theta = blocks.sparse_precision(np.diag([1.0, 2.0, 3.0]) + 0.01, 0.5)
    assert np.allclose(theta, np.diag(np.diag(theta)))
    assert all(len(g) >= 2 for g in blocks.graphical(own, 0.2, 24, 0)) and blocks.graphical(own, 0.2, 24, 0)
    found = blocks.cross_population([own, own], [0.5, 0.5], hint=4)
    assert len(found) == 4 and all(s == pytest.approx(1) for _, s in found)


def test_uncertain_and_blockiness(panel):
    own, _ = band(panel)
    m = own.m
    assert np.allclose(blocks.corrected_r2(own, np.zeros(m), np.ones(m)), own.get("r2"))
    assert (blocks.corrected_r2(own, np.full(m, 0.2), np.ones(m)) >= own.get("r2") - 1e-12).all()
    runs = blocks.uncertain(own, np.zeros(m), np.ones(m), np.ones(m), 0.2)
    near = [own.get("r2")[k, 0] >= 0.2 for k in range(m - 1)]
    assert all(all(near[a:b]) for a, b in runs) and runs
    bad = np.ones(m)
    bad[2] = 0.1
    assert not any(a <= 1 < 2 <= b for a, b in blocks.uncertain(own, np.zeros(m), np.ones(m), bad, 0.2))
    told = blocks.blockiness(own, permutations=50)
    assert 0 < told["blockiness"] <= told["q"] <= 1 and 0 < told["p"] <= 1


def test_detect_on_tables(spark, tables, panel):
    g, _ = panel
    calls, variants = tables
    d = dprime.pair_dprime(ld.genotype_tables(calls, variants, 10_000)).select("i", "j", "dprime", "low", "high")
    pairs = ld.pair_correlations(calls, variants, 10_000).join(d, ["i", "j"])
    own, _ = band(panel)
    for method, options in (("spine", {}), ("gabriel", {"low": 0.5, "high": 0.9, "recombinant": 0.85}), ("big_ld", {"threshold": 0.3}), ("dp", {}), ("aligned", {"most": 8}), ("changepoint", {"penalty": 0.1})):
        rows = blocks.detect(variants, pairs, method, calls if method == "dp" else None, **options).orderBy("start").collect()
        assert [(r.start, r.end, r.n_variants) for r in rows] == [(int(own.pos[a]), int(own.pos[b]), b - a + 1) for a, b in blocks.METHODS[method](own, **options)], method
    sets = {m: blocks.detect(variants, pairs, m, **o) for m, o in (("spine", {}), ("big_ld", {"threshold": 0.3}))}
    row = blocks.compare_all(sets).first()
    assert (row.method_a, row.method_b) == ("big_ld", "spine") and 0 < row.jaccard <= 1
    assert blocks.summary(sets["spine"]).first().n_blocks == sets["spine"].count()
