import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import env_curves, multitrait
from lociframe.operators.env_curves import Basis

LINE = Basis("legendre", 0.0, 4.0, 1)


@pytest.fixture(scope="module")
def data():
    """120 samples in families of 4, two coefficients in two environments; variant 0 acts on all levels, 1 on one environment's change."""
    rng = np.random.default_rng(3)
    n = 120
    family = np.repeat(np.arange(n // 4), 4)
    k = 0.5 * np.eye(n) + 0.5 * (family[:, None] == family[None])
    second = np.exp(-np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / 3)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    g = rng.binomial(2, 0.4, (n, 12)).astype(float)
    sigma = np.kron([[1.0, 0.3], [0.3, 0.5]], [[1.0, 0.5], [0.5, 1.0]])
    y = np.linalg.cholesky(k) @ rng.normal(size=(n, 4)) @ np.linalg.cholesky(sigma).T + rng.normal(size=(n, 4)) * 0.7
    y[:, :2] += g[:, [0]]
    y[:, 3] += g[:, 1]
    return k, second, x, g, y


def test_projection_is_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [(s, e, float(t), float(rng.normal())) for s in range(5) for e in "ab" for t in rng.uniform(0, 9, 8)]
    rows += rows[:3] + [(None, "a", 1.0, 1.0), (1, None, 1.0, 1.0), (1, "a", None, 1.0), (1, "a", 1.0, float("nan")), (9, "a", 2.0, 1.0), (9, "a", 2.0, 1.0)]
    frame = spark.createDataFrame(rows, "s long, e string, t double, v double").withColumn("who", F.lit("clash"))
    whole = np.array([r[2] for r in rows if r[0] is not None and r[2] is not None])
    for options in ({"order": 3}, {"order": 0}, {"kind": "bspline", "interior": 2, "degree": 3}, {"kind": "bspline", "interior": 1, "degree": 2, "knots": "even"}):
        basis = env_curves.pooled_basis(frame, "t", **options)
        assert basis.low == whole.min() and basis.high == whole.max()
        at = frame.where("t is not null").select("t", *(c.alias(f"c{k}") for k, c in enumerate(basis.columns(F.col("t"))))).toPandas().to_numpy()
        assert at.shape[1] == basis.size + 1 and np.allclose(at[:, 1:], basis.values(at[:, 0]))
        found = {(r.who, r.env): r for r in env_curves.project(frame, basis, "s", "e", "t", "v").collect()}
        assert len(found) == 11 and (found[9, "a"].coefficients is None) == (basis.size > 1)
        for s in range(5):
            own = [(r[2], r[3]) for r in rows if r[:2] == (s, "b")]
            t, v = np.array(own).T
            assert found[s, "b"].n_obs == len(own)
            assert np.allclose(found[s, "b"].coefficients, np.linalg.lstsq(basis.values(t), v, rcond=None)[0], atol=1e-6)
    y = env_curves.traits(env_curves.project(frame, LINE, "s", "e", "t", "v"), [0, 9, 77], ["a", "b"], 2)
    assert y.shape == (3, 4) and not np.isnan(y[0]).any() and np.isnan(y[1:]).all()
    assert env_curves.project(frame.limit(0), LINE, "s", "e", "t", "v").count() == 0
    with pytest.raises(ValueError):
        env_curves.pooled_basis(frame, "t", "fourier")


@pytest.mark.parametrize("structure", ["separable", "unstructured", "fa1", "diagonal"])
def test_stacked_fit_is_the_eigenbasis_fit(data, structure):
    k, _, x, g, y = data
    one = env_curves.fit(y, x, [k], list(range(120)), ["a", "b"], LINE, structure)
    found, likelihood, settled, inner = env_curves._stacked(y, x, [k], 2, 2, structure, 300)
    assert settled and likelihood == pytest.approx(one.log_likelihood, abs=2e-3)
    many = env_curves.CurveFit(one.samples, one.environments, LINE, tuple(found[:-1]), found[-1], likelihood, True, inner)
    a, b = env_curves.score(g, (one, (0.0, 3.0))), env_curves.score(g, (many, (0.0, 3.0)))
    assert all(np.allclose(a[name], b[name], rtol=0.05, atol=0.02) for name in a)


def test_slopes_are_derivatives(data):
    k, second, x, _, y = data
    rng = np.random.default_rng(0)
    for structure in ("separable", "unstructured", "fa2", "diagonal"):
        start, build, slope = env_curves._structure(structure, 2, 2, np.eye(4) * 0.5)
        v, weight = start + 0.1 * rng.normal(size=len(start)), rng.normal(size=(4, 4))
        weight = weight + weight.T
        steps = [(np.sum(weight * (build(v + h) - build(v - h))) / 2) / 2e-6 for h in 1e-6 * np.eye(len(v))]
        assert np.allclose(slope(v, weight), steps, atol=1e-6), structure


def test_unseen_cells_and_two_kernels(data):
    """Leaving a kernel's true share out lowers the likelihood; unseen cells leave the tests of what is seen."""
    k, second, x, g, y = data
    y = y.copy()
    y[:20, 1::2] = np.nan
    one = env_curves.fit(y, x, [k], list(range(120)), ["a", "b"], LINE)
    two = env_curves.fit(y, x, [k, second], list(range(120)), ["a", "b"], LINE)
    assert len(two.covariances) == 2 and two.log_likelihood >= one.log_likelihood - 1e-3
    found = env_curves.score(g, (two, ()))
    assert found["p_level_e0"][0] < 1e-4 and found["p_mean"][0] < 1e-4 and found["p_gxe_level"][0] > 0.01
    assert found["p_change_e1"][1] < 1e-4 and found["p_gxe"][1] < 1e-4 and found["p_change_e0"][1] > 0.01
    # without covariance between anything, an environment with unseen samples is the regression of those seen
    seen = ~np.isnan(y[:, 1])
    alone = env_curves._stacked(y, x, [np.eye(120)], 2, 2, "diagonal", 300)
    assert alone[2]
    flat = env_curves.independent(y[seen], x[seen], list(range(100)), ["a", "b"], LINE)
    plain = np.linalg.lstsq(np.column_stack([x[seen], g[seen, 3]]), y[seen], rcond=None)[0][-1]
    assert np.allclose([env_curves.score(g[seen], (flat, ()))[f"beta_c{c}_e{e}"][3] for c in range(2) for e in range(2)], plain)


def test_surfaces(data):
    k, _, x, _, y = data
    one = env_curves.fit(y, x, [k], list(range(120)), ["a", "b"], LINE)
    told = env_curves.surfaces(one, np.array([0.0, 2.0, 4.0]))
    phi = np.kron(LINE.values(np.array([2.0]))[0], [0.0, 1.0])
    assert told["genetic"][1, 1] == pytest.approx(phi @ one.covariances[0] @ phi) and ((told["heritability"] > 0) & (told["heritability"] < 1)).all()
    assert np.allclose(np.diagonal(told["correlation"], axis1=1, axis2=2), 1)
    # separable: environments correlate alike at every time
    assert np.ptp(told["correlation"][:, 0, 1]) < 1e-6
    shares, curves = env_curves.eigenfunctions(one, 0, np.array([0.0, 4.0]))
    assert shares.sum() == pytest.approx(1) and shares[0] >= shares[1] and curves.shape == (2, 2)


def test_scan(spark, data):
    k, _, x, g, y = data
    cells = spark.createDataFrame([(j, i, float(g[i, j])) for i in range(120) for j in range(4)] + [(9, i, 1.0) for i in range(120)], "v_idx long, s_idx long, dosage double")
    y = y.copy()
    y[0, 0::2] = np.nan
    for traits in (y, np.nan_to_num(y)):
        one = env_curves.fit(traits, x, [k], list(range(120)), ["a", "b"], LINE)
        rows = {r["v_idx"]: r for r in env_curves.scan(cells, one, (1.0,)).collect()}
        want = env_curves.score(g[:, :4], (one, (1.0,)))
        assert all(rows[j][name] == pytest.approx(want[name][j], rel=1e-6) for j in range(4) for name in want)
        assert rows[9]["p_all"] is None or np.isnan(rows[9]["p_all"])
    with pytest.raises(ValueError):
        env_curves.fit(y[:, :2], x, [k], list(range(120)), ["a"], LINE)
    assert "gxe" in env_curves.contrasts(2, 3) and env_curves.contrasts(2, 3)["gxe"].shape == (4, 6)
    assert isinstance(one.inner, multitrait.NullFit)
