import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import specfun
from lociframe.operators import bayes, intervals, kinship, ld, mixed, multiple_testing
from lociframe.plans import models, views


def test_tails():
    assert specfun.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert specfun.chi2_sf(0.4549364231195724, 1) == pytest.approx(0.5, rel=1e-10)
    assert specfun.chi2_sf(10.0, 4) == pytest.approx(math.exp(-5) * 6, rel=1e-12)
    assert specfun.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert specfun.f_sf(4.102821015128674, 2.0, 10.0) == pytest.approx(0.05, rel=1e-7)
    assert specfun.norm_ppf([0.975, 0.5, 1e-10, 0.2])[[0, 1, 2, 3]] == pytest.approx([1.959963984540054, 0, -6.361340902404056, -0.8416212335729143], rel=1e-8)
    assert specfun.davies_sf(10.0, np.array([1.0, 1.0, 1.0, 1.0])) == pytest.approx(math.exp(-5) * 6, abs=1e-4)
    assert specfun.liu_sf(10.0, np.ones(4)) == pytest.approx(math.exp(-5) * 6, rel=1e-6)


def test_gig_moments():
    rng = np.random.default_rng(0)
    x = bayes._gig(rng, 0.5, np.full(4000, 2.0), np.full(4000, 3.0))
    # lam = 1/2: the mean is sqrt(chi / psi) * (1 + 1 / sqrt(chi * psi))
    assert x.mean() == pytest.approx(math.sqrt(2 / 3) * (1 + 1 / math.sqrt(6)), rel=0.05)


def test_mixed_model_recovers_heritability():
    rng = np.random.default_rng(1)
    n, m = 400, 800
    g = rng.binomial(2, 0.4, (n, m)).astype(float)
    x = (g - g.mean(0)) / g.std(0)
    k = x @ x.T / m
    y = x @ rng.normal(0, math.sqrt(0.6 / m), m) + rng.normal(0, math.sqrt(0.4), n)
    fit = mixed.fit_null(y, np.ones((n, 1)), k, list(range(n)))
    assert 0.3 < fit.sigma2_g / (fit.sigma2_g + fit.sigma2_e) < 0.9
    _, _, p = mixed.score(fit, rng.binomial(2, 0.4, (n, 500)).astype(float))
    assert 0.02 < (p < 0.05).mean() < 0.09
    sets = mixed.set_tests(fit, rng.binomial(2, 0.2, (n, 10)).astype(float), np.ones(10))
    assert all(0 < sets[q] <= 1 for q in ("p_skat", "p_burden", "p_skato"))


def test_mixed_without_kinship_is_regression():
    rng = np.random.default_rng(2)
    y, g = rng.normal(size=60), rng.binomial(2, 0.5, (60, 5)).astype(float)
    fit = mixed.fit_null(y, np.ones((60, 1)), np.eye(60), list(range(60)))
    beta, se, _ = mixed.score(fit, g)
    for k in range(5):
        x = np.column_stack([np.ones(60), g[:, k]])
        b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert beta[k] == pytest.approx(b[1]) and se[k] == pytest.approx(math.sqrt(rss[0] / 58 * np.linalg.inv(x.T @ x)[1, 1]), rel=1e-6)


def test_finemapping_finds_the_signal():
    rng = np.random.default_rng(3)
    m, n = 60, 5000
    r = 0.8 ** np.abs(np.subtract.outer(np.arange(m), np.arange(m)))
    b = np.zeros(m)
    b[[10, 40]] = 0.1
    z = math.sqrt(n) * r @ b + np.linalg.cholesky(r) @ rng.normal(size=m)
    pip, _ = bayes.susie_rss(z, r, n)
    assert {10, 40} <= set(np.argsort(pip)[-6:]) and pip[[0, 25, 55]].max() < 0.2
    weights = bayes.ldpred_inf(z, r, n, 0.3, m)
    gibbs, _, _ = bayes.ldpred_gibbs(z, r, n, 0.3, 0.05, m)
    assert np.corrcoef(r @ b, r @ weights)[0, 1] > 0.9 and np.corrcoef(r @ b, r @ gibbs)[0, 1] > 0.9
    assert np.corrcoef(r @ b, r @ bayes.prs_cs(z, r, n, draws=60))[0, 1] > 0.9


def test_clump_brute_force(spark, sf):
    hits, pairs = views.pvals(spark, sf), ld.pair_correlations(views.geno(spark, sf), views.variants(spark, sf), 5000)
    strong = {(x["i"], x["j"]) for x in pairs.where("r * r >= 0.05").collect()}
    strong |= {(b, a) for a, b in strong}
    want = []
    for chrom in range(5):
        taken = set()
        for v, p in sorted(((x["v_idx"], x["p"]) for x in hits.where(F.col("chr") == f"chr{chrom}").collect()), key=lambda t: (t[1], t[0])):
            if p <= 0.5 and v not in taken:
                own = {v} | {o for a, o in strong if a == v and o not in taken}
                taken |= own
                want += [(v, o) for o in own]
    got = [(x["index"], x["member"]) for x in ld.clump(hits, pairs, 0.5, 0.05).collect()]
    assert sorted(got) == sorted(want)


def test_gram_agrees_with_numpy(spark, sf):
    ids = models.sample_ids(spark, sf)
    cells = models.cells(spark, sf)
    k = kinship.relationship(cells, ids)
    table = cells.toPandas().pivot(index="s_idx", columns="v_idx", values="dosage").loc[ids]
    g = table.fillna(table.mean()).to_numpy()
    p = g.mean(0) / 2
    x = g - 2 * p
    assert np.allclose(k, x @ x.T / (2 * p * (1 - p)).sum())
    assert np.trace(kinship.standardised(k)) / (len(k) - 1) == pytest.approx(1, rel=0.2)


def test_range_join_edges(spark):
    points = spark.createDataFrame([("1", p) for p in (0, 9, 10, 19, 20, 99_999, 100_000, 250_000)], "chr string, pos long")
    ranges = spark.createDataFrame([("a", "1", 10, 20), ("b", "1", 99_999, 250_000), ("c", "2", 0, 50)], "region string, chr string, lo long, hi long")
    half = sorted((r.region, r.pos) for r in intervals.range_join(points, ranges, "lo", "hi").collect())
    assert half == [("a", 10), ("a", 19), ("b", 99_999), ("b", 100_000)]
    closed = sorted((r.region, r.pos) for r in intervals.range_join(points, ranges, "lo", "hi", closed=True).collect())
    assert closed == [("a", 10), ("a", 19), ("a", 20), ("b", 99_999), ("b", 100_000), ("b", 250_000)]


def test_corrections_with_ties_and_extremes(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(300), [0.0, 1e-300, 1.0, 1.0, 0.5, 0.5], 10 ** -rng.uniform(1, 40, 60)])
    frame = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "k long, p double")
    order = np.lexsort((np.arange(len(p)), p))
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    got = {r.k: r.p_adj for r in multiple_testing.benjamini_hochberg(frame, ["k"]).collect()}
    assert np.allclose([got[k] for k in range(len(p))], np.minimum(want, 1))
