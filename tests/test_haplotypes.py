"""Haplotype tests, stored LD and plots."""

import xml.etree.ElementTree as tree

import numpy as np
import pytest

from lociframe import viz

from lociframe.operators import haplotypes, ld, ld_reference, mixed, multitrait


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(2)
    n = 150
    kinds = np.array([[0, 0, 0, 0], [1, 1, 0, 0], [0, 1, 1, 0], [1, 0, 1, 1]])
    own = rng.choice(4, (2, n, 2), p=[0.4, 0.3, 0.2, 0.1])
    y = 1.8 * (own[0] == 2).sum(axis=1) + rng.standard_normal(n)
    rows = [(4 * r + v, s, c, int(kinds[own[r, s, c], v])) for r in range(2) for s in range(n) for c in range(2) for v in range(4)]
    calls = spark.createDataFrame(rows, "v_idx long, s_idx long, copy int, allele int")
    regions = spark.createDataFrame([(f"r{v // 4}", v) for v in range(8)], "region string, v_idx long")
    x = np.column_stack([np.ones(n), rng.standard_normal(n)])
    fit = mixed.fit_eigen(y, x, np.zeros(n), np.eye(n), list(range(n)), 1.0)
    return calls, regions, y, x, fit, own, rng


def test_region_scan(study):
    calls, regions, y, x, fit, own, _ = study
    rows = {r.region: r for r in haplotypes.scan(calls, regions, fit).collect()}
    assert rows["r0"].n_haplotypes == 4 and rows["r0"].df == 3 and rows["r0"].p < 1e-4 < 0.01 < rows["r1"].p and rows["r0"].p_kernel < 1e-3
    # without relationship the score statistic is the explained share of the residual sum
    d = np.stack([(own[0] == k).sum(axis=1) for k in (1, 2, 3)], axis=1).astype(float)
    rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    assert rows["r0"].stat == pytest.approx((rss(x) - rss(np.column_stack([x, d]))) / (rss(x) / (len(y) - 2)))
    assert haplotypes.score_test(d, fit, np.eye(3) * 50)[0] < rows["r0"].stat
    assert haplotypes.inclusion(d, fit).argmax() == 1 and haplotypes.inclusion(d, fit).sum() == pytest.approx(1)


def test_posterior_covariance():
    rng = np.random.default_rng(3)
    chances = rng.dirichlet(np.ones(6), 4)
    draws = np.zeros((3, 3))
    pairs = list(zip(*np.triu_indices(3)))
    for row in chances:
        at = rng.choice(6, 40_000, p=row)
        values = np.array([[int(a == k) + int(b == k) for k in range(3)] for a, b in pairs], float)[at]
        draws += np.cov(values.T)
    assert np.allclose(haplotypes.posterior_covariance(chances), draws, atol=0.05)
    assert np.allclose(haplotypes.posterior_covariance(np.eye(6)), 0)


def test_interaction_and_joint(study):
    calls, regions, y, x, fit, own, rng = study
    n = len(y)
    z = rng.standard_normal(n)
    yi = 1.6 * z * (own[1] == 1).sum(axis=1) + rng.standard_normal(n)
    for null in (None, mixed.fit_eigen(yi, x, np.zeros(n), np.eye(n), list(range(n)), 1.0)):
        rows = {r.region: r for r in haplotypes.scan_interaction(calls, regions, list(range(n)), yi, np.column_stack([x, z]), z, null).collect()}
        assert rows["r1"].p_interact < 1e-4 < 0.01 < rows["r0"].p_interact and rows["r1"].p_joint < 1e-3
    two = multitrait.null_fit(np.column_stack([y, yi]), x, np.zeros(n), np.eye(n), list(range(n)), np.eye(2), np.eye(2) * 1.5)
    rows = {r.region: r for r in haplotypes.scan_joint(calls, regions, two).collect()}
    assert rows["r0"].df == 6 and rows["r0"].p < 1e-3
    one = multitrait.null_fit(y[:, None], x, np.zeros(n), np.eye(n), list(range(n)), np.eye(1) * 0.1, np.array([[fit.sigma2_e]]))
    d = np.stack([(own[0] == k).sum(axis=1) for k in (1, 2, 3)], axis=1).astype(float)
    assert haplotypes.multi_test(d, one)[0] == pytest.approx(haplotypes.score_test(d, fit)[0], rel=1e-6)


def test_stored_ld(spark, tmp_path):
    rng = np.random.default_rng(4)
    g = rng.binomial(2, 0.4, (50, 12)).astype(float)
    calls = spark.createDataFrame([(v, s, float(g[s, v])) for v in range(12) for s in range(50)], "v_idx long, s_idx long, dosage double")
    variants = spark.createDataFrame([(v, str(1 + v // 6), 1000 * v) for v in range(12)], "v_idx long, chr string, pos long")
    pairs = ld.pair_correlations(calls, variants, 10_000)
    ld_reference.save(variants, pairs, str(tmp_path / "ref"), population="a", n_samples=50, window=10_000)
    v, p, about = ld_reference.load(spark, str(tmp_path / "ref"), ["1"])
    assert v.count() == 6 and p.count() == 15 and about["n_variants"] == 12
    ld_reference.check(about, {"population": "a", "n_samples": 40})
    with pytest.raises(ld_reference.Mismatch):
        ld_reference.check(about, {"population": "b"})
    with pytest.raises(ld_reference.Mismatch):
        ld_reference.check(about, {"n_samples": 60})
    scores = {r.v_idx: r.cross_score for r in ld_reference.cross_scores(pairs, pairs, variants).collect()}
    plain = {r.v_idx: r.ld_score for r in ld.scores(pairs, variants).collect()}
    assert scores == pytest.approx(plain)
    blocks = spark.createDataFrame([("1", 0, 0, 3000)], "chr string, block long, start long, end long")
    assert sorted(r.block for r in ld_reference.blocks_of(variants, blocks).collect())[:4] == ["1:0"] * 4


def test_plots(spark):
    rng = np.random.default_rng(5)
    rows = [(k, str(1 + k % 3), int(rng.integers(1, 10**6)), float(p), float(rng.standard_normal()), float(rng.random())) for k, p in enumerate([*rng.random(3000), 1e-12])]
    scan = spark.createDataFrame(rows, "v_idx long, chr string, pos long, p double, beta double, af double")
    for text in (viz.manhattan(scan), viz.miami(scan, scan), viz.circular(scan), viz.qq(scan), viz.trumpet(scan)):
        root = tree.fromstring(text)
        points = [e for e in root.iter() if e.tag.endswith("circle")]
        assert 50 < len(points) <= 6002 and all(np.isfinite(float(e.get("cx"))) for e in points)
    assert sum(e.get("fill") == viz.MARK for e in tree.fromstring(viz.manhattan(scan)).iter()) == 1
    variants = scan.where("v_idx < 5").select("v_idx", "chr", "pos")
    pairs = spark.createDataFrame([(0, 3, 0.5), (1, 4, -1.0)], "i long, j long, r double")
    assert sum(e.tag.endswith("polygon") for e in tree.fromstring(viz.triangle(pairs, variants)).iter()) == 2
    with pytest.raises(ValueError):
        viz.triangle(pairs, scan)

