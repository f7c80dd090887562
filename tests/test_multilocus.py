import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociframe.operators import longitudinal, multilocus


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(9)
    n, m = 200, 60
    g = rng.binomial(2, 0.4, (n, m)).astype(float)
    g[:, 1] = np.where(rng.random(n) < 0.9, g[:, 0], g[:, 1])  # a neighbour in LD with the first driver
    y = 1.0 * g[:, 0] + 0.8 * g[:, 30] + rng.normal(size=n)
    cells = spark.createDataFrame(pd.DataFrame({"v_idx": np.tile(np.arange(m), n), "s_idx": np.repeat(np.arange(n), m), "dosage": g.ravel()})).persist()
    variants = spark.createDataFrame([(k, "1", 1000 * k) for k in range(m)], "v_idx long, chr string, pos long")
    return cells, variants, list(range(n)), y, np.ones((n, 1)), g


def test_leads(study):
    cells, _, ids, y, x, g = study
    leads = [r.v_idx for r in multilocus.conditional_leads(cells, ids, y, x, 1e-6).orderBy("round").collect()]
    assert set(leads) == {0, 30} and leads[0] == int(np.argmax(np.abs(np.corrcoef(g.T, y)[-1, :-1])))


def test_blink_and_farmcpu(study):
    cells, variants, ids, y, x, _ = study
    assert set(multilocus.blink(cells, ids, y, x, 1e-4)[1]) == {0, 30}
    found, chosen = multilocus.farmcpu(cells, variants, ids, y, x, 5000, threshold=1e-4)
    assert set(chosen) == {0, 30} and found.where("v_idx = 5").first().p > 1e-4


def test_linear_against_least_squares(study):
    _, _, _, y, _, g = study
    x = np.column_stack([np.ones(len(y)), g[:, 3]])
    got = multilocus.score_linear(g[:, [5, 3]], {"y": y, "x": x})
    full = np.column_stack([x, g[:, 5]])
    b, rss, *_ = np.linalg.lstsq(full, y, rcond=None)
    assert got["beta"][0] == pytest.approx(b[2]) and np.isnan(got["p"][1])
    assert got["se"][0] == pytest.approx(np.sqrt(rss[0] / (len(y) - 3) * np.linalg.inv(full.T @ full)[2, 2]))


def test_knockoffs_match_second_moments():
    rng = np.random.default_rng(1)
    g = rng.normal(size=(20_000, 4)) @ np.linalg.cholesky(0.5 * np.eye(4) + 0.5).T
    k = multilocus.knockoffs(g)
    assert np.allclose(np.cov(k.T), np.cov(g.T), atol=0.08)
    cross = (np.corrcoef(g.T, k.T)[:4, 4:] + np.corrcoef(g.T, k.T)[:4, 4:].T) / 2
    off = ~np.eye(4, dtype=bool)
    assert np.allclose(cross[off], np.corrcoef(g.T)[off], atol=0.08) and (np.diag(cross) < 0.6).all()


def test_knockoff_scan_ranks_drivers(study):
    cells, variants, ids, y, x, _ = study
    w = {r.v_idx: r.w for r in multilocus.knockoff_statistics(cells, variants, ids, y, x).collect()}
    assert len(w) == 60 and w[30] == max(w.values()) or w[0] == max(w.values())


def test_cross_fitting(study):
    cells, _, ids, y, x, _ = study
    rows = {r.v_idx: r for r in multilocus.cross_fitted(cells, ids, y, x).collect()}
    assert rows[0].p < 1e-6 and rows[30].p < 1e-6 and np.mean([rows[k].p < 0.05 for k in range(2, 30)]) < 0.25


def test_haplotypes(spark, study):
    _, _, ids, y, x, g = study
    rows = [(v, s, c, int(g[s, v] > c)) for v in (0, 1, 10, 11) for s in ids for c in (0, 1)]
    haps = spark.createDataFrame(rows, "v_idx long, s_idx long, copy int, allele int")
    regions = spark.createDataFrame([("a", 0), ("a", 1), ("b", 10), ("b", 11)], "region string, v_idx long")
    got = {r.region: r for r in multilocus.haplotype_test(haps, regions, ids, y, x).collect()}
    assert got["a"].p < 1e-6 < got["b"].p and got["b"].n_haplotypes <= 4


def test_bases(spark):
    t = np.linspace(-1, 1, 2001)
    row = spark.range(1).select(*(c.alias(f"p{k}") for k, c in enumerate(longitudinal.legendre(F.lit(0.5), 3)))).first()
    want = [np.sqrt((2 * k + 1) / 2) * np.polynomial.legendre.Legendre.basis(k)(0.5) for k in range(4)]
    assert list(row) == pytest.approx(want)
    b = longitudinal.bspline(t, np.linspace(-1, 1, 5))
    assert b.shape == (2001, 7) and np.allclose(b.sum(axis=1), 1) and (b >= -1e-12).all()
    assert np.allclose(longitudinal.difference_penalty(6) @ np.arange(6.0), 0)


def test_curves(spark):
    rows = [(k, float(t), 1.0 + k * t + 0.5 * t * t) for k in range(3) for t in range(5)] + [(9, 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "who long, time double, value double")
    got = {r.who: r.coefficients for r in longitudinal.individual_coefficients(frame, "who", "time", "value").collect()}
    assert set(got) == {0, 1, 2}
    s = 0.5 * np.array(range(5)) - 1
    basis = np.column_stack([np.sqrt((2 * k + 1) / 2) * np.polynomial.legendre.Legendre.basis(k)(s) for k in range(3)])
    assert all(np.allclose(basis @ c, [1.0 + k * t + 0.5 * t * t for t in range(5)]) for k, c in got.items())


def test_curves_are_least_squares_and_gather_no_measures(spark, monkeypatch):
    """Usual individuals by sums; close, few, repeated and null ones by their different times."""
    rng = np.random.default_rng(6)
    times = {0: rng.uniform(0, 1000, 40), 1: 500 + rng.uniform(0, 0.5, 30), 2: [0, 1, 1000], 3: [5.0] * 8 + [6.0] * 3, 4: [7.0, 7.5, 8.0] * 20, 5: [1.0, 2.0], None: [1.0, 500.0, 900.0, 950.0]}
    rows = [(k, float(t), float(rng.normal())) for k, own in times.items() for t in own]
    frame = spark.createDataFrame(rows, "who long, time double, value double")
    got = {r.who: r.coefficients for r in longitudinal.individual_coefficients(frame, "who", "time", "value").collect()}
    assert set(got) == {0, 1, 2, 4, None}
    low, high = min(t for _, t, _ in rows), max(t for _, t, _ in rows)
    for k, c in got.items():
        t, y = np.array([(t, v) for o, t, v in rows if o == k]).T
        s = 2 * (t - low) / (high - low) - 1
        b = np.column_stack([np.sqrt((2 * j + 1) / 2) * np.polynomial.legendre.Legendre.basis(j)(s) for j in range(3)])
        want = np.linalg.lstsq(b, y, rcond=None)[0]
        assert np.allclose(b @ c, b @ want, atol=1e-6) and np.allclose(c, want, rtol=1e-5)
    monkeypatch.setattr(F, "collect_list", lambda c: F.lit(None).cast("array<double>"))
    usual = longitudinal.individual_coefficients(frame.where("who = 0"), "who", "time", "value").collect()
    assert len(usual) == 1


def test_knockoffs_by_some_samples_are_those_of_all(spark, study, monkeypatch):
    """Steps and tiles of samples change nothing; a block takes one matrix beside what it works on."""
    cells, variants, ids, y, x, _ = study
    want = {r.v_idx: r.w for r in multilocus.knockoff_statistics(cells, variants, ids, y, x).collect()}
    monkeypatch.setattr(multilocus, "TILE", 50)
    got = {r.v_idx: r.w for r in multilocus.knockoff_statistics(cells, variants, ids, y, x).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)
    g = np.random.default_rng(2).integers(0, 3, (30_000, 20)).astype(float)
    whole = multilocus.knockoffs(g, 5)
    monkeypatch.setattr(multilocus, "CELLS", 1 << 14)
    tracemalloc.start()
    some = multilocus.knockoffs(g.copy(), 5)
    took = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(some, whole, atol=1e-9) and took < 2.5 * g.nbytes
