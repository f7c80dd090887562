import math

import numpy as np
import pytest

from lociframe.functions import specfun
from lociframe.operators import glm


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 300
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    g = rng.binomial(2, 0.3, (n, 40)).astype(float)
    eta = 0.4 * x[:, 1] + 0.5 * g[:, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta + 0.5))).astype(float)
    return rng, x, g, eta, y


def test_two_levels_agree(data):
    _, x, g, _, y = data
    a = glm.score_logistic(g, glm.fit_logistic(y, x), spa_above=1e9)
    b = glm.score_multinomial(g, glm.fit_multinomial(y.astype(int), x))
    c = glm.score_ordinal(g, glm.fit_ordinal(y.astype(int), x[:, 1:]))
    assert np.allclose(a["chi2"], b["chi2"], rtol=1e-5) and np.allclose(a["chi2"], c["chi2"], rtol=1e-4)
    assert a["p"][0] < 0.01 and np.sign(a["beta"][0]) == np.sign(c["u"][0]) == 1


def test_saddlepoint_exact():
    # g = 1 and mu = 0.2: the sum is binomial; the continuous approximation lies between neighbouring tails
    n, mu = 60, 0.2
    tail = lambda k: sum(math.comb(n, j) * mu**j * (1 - mu) ** (n - j) for j in range(k, n + 1))
    for k in (18, 22, 26):
        got = glm.saddlepoint(k - n * mu, np.ones(n), np.full(n, mu))
        assert tail(k + 1) < got < tail(k)


def test_null_is_uniform(data):
    rng, x, _, eta, _ = data
    g = rng.binomial(2, 0.3, (300, 1500)).astype(float)
    level = np.digitize(eta + rng.logistic(size=300), [-0.5, 1.0])
    time, event = rng.exponential(np.exp(-eta)), rng.random(300) < 0.7
    found = {
        "ordinal": glm.score_ordinal(g, glm.fit_ordinal(level, x[:, 1:]))["p"], "multinomial": glm.score_multinomial(g[:, :400], glm.fit_multinomial(level, x))["p"],
        "cox": glm.score_cox(g, glm.fit_cox(time, event, x[:, 1:]))["p"], "multi": glm.score_multi_trait(g, {"y": rng.normal(size=(300, 3)), "x": x})["p"],
    }
    for name, p in found.items():
        assert 0.025 < (p < 0.05).mean() < 0.08, name
        assert 0.42 < p.mean() < 0.58, name


def test_interaction_against_least_squares(data):
    rng, x, g, _, _ = data
    y, z = rng.normal(size=300), x[:, 1]
    got = glm.score_interaction(g, {"y": y, "x": x, "z": z})
    rss = lambda *cols: np.linalg.lstsq(np.column_stack([x, *cols]), y, rcond=None)[1][0]
    for k in range(5):
        a, b = g[:, k], g[:, k] * z
        full = rss(a, b)
        assert got["p_interact"][k] == pytest.approx(float(specfun.f_sf((rss(a) - full) / (full / 296), 1.0, 296.0)), rel=1e-6)
        assert got["p_main"][k] == pytest.approx(float(specfun.f_sf((rss(b) - full) / (full / 296), 1.0, 296.0)), rel=1e-6)
        assert got["stat_joint"][k] == pytest.approx((np.linalg.lstsq(x, y, rcond=None)[1][0] - full) / 2 / (full / 296), rel=1e-6)


def test_cox_score_is_the_derivative(data):
    rng, x, g, _, _ = data
    time, event = rng.integers(1, 20, 300).astype(float), rng.random(300) < 0.6
    fit = glm.fit_cox(time, event, x[:, 1:])

    def likelihood(b):
        eta = np.log(fit["e"]) + b * g[fit["order"], 0]
        risk = np.log(np.cumsum(np.exp(eta))[fit["last"]])
        return (fit["event"] * (eta - risk)).sum()

    h = 1e-4
    slope = (likelihood(h) - likelihood(-h)) / (2 * h)
    got = glm.score_cox(g[:, :1], fit)
    assert got["beta"][0] == 0 or slope / got["beta"][0] > 0
    assert got["chi2"][0] == pytest.approx(slope * got["beta"][0], rel=1e-4)
