import numpy as np
import pytest

from lociframe.operators import field, linalg, multitrait


@pytest.fixture(scope="module")
def plots():
    """14 x 14 plots of families with a wavy trend; variant 0 acts."""
    rng = np.random.default_rng(4)
    rows, columns = (v.ravel().astype(float) for v in np.meshgrid(np.arange(14), np.arange(14)))
    n = len(rows)
    family = rng.permutation(np.repeat(np.arange(n // 4), 4))
    k = 0.5 * np.eye(n) + 0.5 * (family[:, None] == family[None])
    trend = 2 * np.sin(rows / 3) + 0.15 * columns + 1.5 * np.cos(rows / 4) * np.sin(columns / 3)
    g = rng.binomial(2, 0.4, (n, 6)).astype(float)
    y = 0.5 * g[:, 0] + np.linalg.cholesky(k) @ rng.normal(size=n) * 0.5 + trend + rng.normal(size=n) * 0.5
    return rows, columns, k, trend, g, y


def test_parts_span_the_spline_surface(plots):
    rows, columns, *_ = plots
    fixed, kernels = field.parts(rows, columns, 4)
    basis, _, _ = linalg.surface(rows, columns, 4, 4)
    mine = np.column_stack([np.ones(len(rows)), fixed, *kernels])
    assert np.linalg.matrix_rank(mine, 1e-8) == np.linalg.matrix_rank(basis, 1e-8) == np.linalg.matrix_rank(np.column_stack([mine, basis]), 1e-8)
    assert fixed.shape[1] == 3 and len(kernels) == 5


def test_trend_and_scan(spark, plots):
    rows, columns, k, trend, g, y = plots
    n = len(y)
    found, told = field.fit(y, np.ones((n, 1)), k, rows, columns, list(range(n)))
    assert np.corrcoef(told, trend)[0, 1] > 0.97 and len(found.variances) == 7
    bare = multitrait.fit_kernels(y, np.ones((n, 1)), [k], list(range(n)))
    assert multitrait.score_kernels(g, found)["p"][0] < multitrait.score_kernels(g, bare)["p"][0] and multitrait.score_kernels(g, found)["p"][0] < 1e-5
    cells = spark.createDataFrame([(j, i, float(g[i, j])) for i in range(n) for j in range(3)], "v_idx long, s_idx long, dosage double")
    rows_out = {r["v_idx"]: r["p"] for r in multitrait.scan_kernels(cells, found).collect()}
    assert all(rows_out[j] == pytest.approx(multitrait.score_kernels(g, found)["p"][j], rel=1e-6) for j in range(3))


def test_no_field_is_the_plain_model(plots):
    _, _, k, _, g, y = plots
    n = len(y)
    found, told = field.fit(y, np.ones((n, 1)), k, np.ones(n), np.ones(n), list(range(n)))
    bare = multitrait.fit_kernels(y, np.ones((n, 1)), [k], list(range(n)))
    assert np.allclose(told, 0) and np.allclose(found.variances, bare.variances)
    one = field.fit(y, np.ones((n, 1)), k, np.arange(n) % 14, np.ones(n), list(range(n)))[0]
    assert len(one.variances) == 3
