"""Uncertain dosages, regions left out, joint loci, spike and slab, collapsing of haplotypes, fields."""

import numpy as np
import pytest

from lociframe.operators import association, kinship, mixed


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n, m = 90, 60
    g = rng.binomial(2, 0.4, (n, m)).astype(float)
    y = 0.9 * g[:, 3] + 0.7 * g[:, 40] + rng.standard_normal(n)
    x = np.column_stack([np.ones(n), rng.standard_normal(n)])
    z = g - g.mean(axis=0)
    return g, y, x, z @ z.T / (2 * (g.mean(axis=0) / 2 * (1 - g.mean(axis=0) / 2)).sum()), rng


def table(spark, g, columns="v_idx long, s_idx long, dosage double"):
    return spark.createDataFrame([(v, s, float(g[s, v])) for v in range(g.shape[1]) for s in range(len(g))], columns)


def test_uncertain_dosages(spark, data):
    g, y, x, k, rng = data
    fit = mixed.fit_null(y, x, k, list(range(len(y))))
    h = np.linalg.inv(np.eye(len(y)) + fit.ratio * k)
    p = h - h @ x @ np.linalg.inv(x.T @ h @ x) @ x.T @ h
    assert association.projection_diagonal(fit) == pytest.approx(np.diag(p))
    noise = rng.random(g.shape) * 0.3
    rows = [(v, s, float(g[s, v]), float(noise[s, v])) for v in range(5) for s in range(len(y))]
    got = association.scan_uncertain(spark.createDataFrame(rows, "v_idx long, s_idx long, expected double, variance double"), fit).toPandas().sort_values("v_idx")
    info = np.einsum("iv,ij,jv->v", g, p, g)[:5]
    extra = (noise * np.diag(p)[:, None]).sum(axis=0)[:5]
    assert got["beta"].to_numpy() == pytest.approx((g.T @ p @ y)[:5] / (info + extra)) and got["noise_share"].to_numpy() == pytest.approx(extra / (info + extra))


def test_regions_left_out(spark, data):
    g, y, x, _, _ = data
    cells = table(spark, g).selectExpr("*", "v_idx div 20 as region")
    got = association.scan_left_out(cells, y, x, list(range(len(y))), "region", tile=32).toPandas().sort_values("v_idx")
    for region in range(3):
        k = kinship.relationship(table(spark, g).where(f"v_idx div 20 <> {region}"), list(range(len(y))))
        beta, _, p = mixed.score(mixed.fit_null(y, x, k, list(range(len(y)))), g[:, 20 * region : 20 * region + 20])
        own = got[got["region"] == region]
        assert own["beta"].to_numpy() == pytest.approx(beta, rel=1e-6) and own["p"].to_numpy() == pytest.approx(p, rel=1e-5)


def test_joint_loci(data):
    g, y, x, _, _ = data
    plain = mixed.fit_eigen(y, x, np.zeros(len(y)), np.eye(len(y)), list(range(len(y))), 1.0)
    found = association.joint_loci(y, x, g[:, [3, 10, 40, 50]], plain, ["a", "b", "c", "d"], 0.01)
    assert [f["name"] for f in found] == ["a", "c"]
    want = np.linalg.lstsq(np.column_stack([x, g[:, [3, 40]]]), y, rcond=None)[0][2:]
    assert [f["beta"] for f in found] == pytest.approx(want)
    assert len(association.joint_loci(y, x, g[:, [3, 3, 40]], plain, ["a", "a2", "c"], None)) == 2


def test_spike_and_slab(data):
    g, y, _, _, _ = data
    alpha, beta, bounds = association.spike_and_slab(y, g)
    assert set(np.argsort(-alpha)[:2]) == {3, 40} and alpha[[3, 40]].min() > 0.8 and np.median(alpha) < 0.1
    assert beta[3] == pytest.approx(0.9, abs=0.4)
    fixed = association.spike_and_slab(y, g, 0.05, 0.3, learn=False)[2]
    assert all(b >= a - 1e-8 for a, b in zip(fixed, fixed[1:]))


def test_collapse_follows_the_tree():
    rng = np.random.default_rng(3)
    n, names = 300, ["0000", "0001", "1110", "1111"]
    own = rng.integers(0, 5, (n, 2))
    d = np.stack([(own == k).sum(axis=1) for k in range(4)], axis=1).astype(float)
    y = 0.9 * (d[:, 2] + d[:, 3]) + rng.standard_normal(n)
    fit = mixed.fit_eigen(y, np.ones((n, 1)), np.zeros(n), np.eye(n), list(range(n)), 1.0)
    found = {tuple(f["haplotypes"]): f for f in association.collapse(d, names, fit)}
    assert found[tuple(names)]["p_adj"] < 1e-4 and found["1110", "1111"]["p_adj"] < 1e-4
    assert all(f["p_adj"] >= found[tuple(names)]["p_adj"] for f in found.values())
    none = association.collapse(d, names, mixed.fit_eigen(rng.standard_normal(n), np.ones((n, 1)), np.zeros(n), np.eye(n), list(range(n)), 1.0))
    assert len(none) == 1


def test_fields():
    rng = np.random.default_rng(4)
    row, column = np.repeat(np.arange(10.0), 10), np.tile(np.arange(10.0), 10)
    slope = rng.standard_normal(100)
    times = np.array([0.0, 1.0, 2.0])
    clean = 1 + np.outer(slope, times)
    trend = 3 * np.sin(row / 3) + 0.5 * column
    got = association.random_regression_in_field(clean + trend[:, None] + 0.05 * rng.standard_normal((100, 3)), times, row, column)
    assert np.corrcoef(got[:, 1], slope)[0, 1] > 0.9
