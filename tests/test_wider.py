import numpy as np
import pandas as pd
import pytest

from lociframe.functions import specfun
from lociframe.operators import blocks, evidence, genetics_extra


def test_partitioned_heritability_recovers(spark):
    rng = np.random.default_rng(2)
    m, n = 20_000, 50_000.0
    a, b = rng.gamma(2, 3, m), rng.gamma(2, 3, m)
    chi2 = (1 + n * (2e-6 * a + 5e-7 * b)) * rng.normal(size=m) ** 2
    frame = spark.createDataFrame(pd.DataFrame({"chi2": chi2, "n": n, "a": a, "b": b}))
    got = {r.annotation: r for r in genetics_extra.partitioned_heritability(frame, ["a", "b"], {"a": 1e5, "b": 1e5}).collect()}
    assert got["a"].h2 == pytest.approx(0.2, abs=0.03) and got["b"].h2 == pytest.approx(0.05, abs=0.03) and got["a"].enrichment > 1 > got["b"].enrichment


def test_genetic_correlation_recovers(spark):
    rng = np.random.default_rng(3)
    m, n = 40_000, 40_000.0
    l = rng.gamma(2, 4, m)
    s = np.sqrt(n * l * 4e-6)
    u = rng.normal(size=(m, 2)) @ np.linalg.cholesky(np.array([[1, 0.6], [0.6, 1]])).T
    z = s[:, None] * u + rng.normal(size=(m, 2))
    frame = spark.createDataFrame(pd.DataFrame({"z1": z[:, 0], "z2": z[:, 1], "n1": n, "n2": n, "ld_score": l}))
    row = genetics_extra.ldsc_covariance(frame, 1e5).first()
    assert row.rg == pytest.approx(0.6, abs=0.08) and row.h2_1 == pytest.approx(0.4, abs=0.06)


def test_brown_limits():
    p = np.array([0.01, 0.2, 0.5])
    stat = -2 * np.log(p).sum()
    assert genetics_extra.brown(p, np.eye(3)) == pytest.approx(float(specfun.chi2_sf(stat, 6.0)))
    assert genetics_extra.brown(np.full(4, 0.01), np.ones((4, 4))) == pytest.approx(0.01, rel=0.3)


def test_copying_imputes_from_twins():
    rng = np.random.default_rng(4)
    g = np.repeat(rng.integers(0, 3, (6, 40)).astype(float), 2, axis=0)
    holes = g.copy()
    holes[0, 10:14] = np.nan
    assert np.abs(genetics_extra.copying_posterior(holes)[0, 10:14] - g[0, 10:14]).max() < 0.35


def test_knn(spark):
    cells = spark.createDataFrame([(0, 0, None), (0, 1, 2.0), (0, 2, 0.0), (1, 0, 1.0), (1, 1, None), (1, 2, None)], "v_idx long, s_idx long, dosage double")
    near = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 0, 0.9), (1, 2, 0.2), (2, 1, 0.2)], "s_idx long, other long, w double")
    got = {(r.v_idx, r.s_idx): r.dosage for r in genetics_extra.impute_knn(cells, near, 2).collect()}
    assert got[0, 0] == pytest.approx(1.8) and got[1, 1] == 1.0 and got[1, 2] == 1.0


def test_changepoints():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(40, 0.0), np.full(30, 3.0), np.full(50, -1.0)]) + rng.normal(0, 0.3, 120)
    assert blocks.changepoint(x, 5.0) == [(0, 39), (40, 69), (70, 119)]


def test_han_eskin_and_stouffer(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.1), ("a", 0.5, 0.1), ("b", 0.01, 0.1), ("b", -0.02, 0.1), ("c", 1.0, 0.1), ("c", -1.0, 0.1)], "snp string, beta double, se double")
    got = {r.snp: r.p for r in evidence.han_eskin(rows).collect()}
    assert got["a"] < 1e-8 and got["b"] > 0.5 and got["c"] < 1e-8
    p = spark.createDataFrame([("g", 0.5), ("g", 0.5), ("h", 0.001), ("h", 0.001)], "gene string, p double")
    got = {r.gene: r.p_stouffer for r in evidence.stouffer(p, "gene").collect()}
    assert got["g"] == pytest.approx(1.0) and got["h"] < 1e-4
