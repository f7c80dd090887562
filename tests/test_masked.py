import numpy as np
from pyspark.sql import functions as F

from lociframe.operators import hypotheses

CELLS, RATIO = 120, 0.86


def draw(rng, n=4000):
    """p-values whose share of effects depends on a covariate."""
    c = rng.random(n)
    real = rng.random(n) < np.where(c > 0.8, 0.5, 0.02)
    return c, real, np.where(real, rng.beta(0.15, 1.0, n), rng.random(n))


def counts(c, p):
    b, v = np.minimum((c * 5).astype(int), 4), np.minimum(p, 1 - p)
    cell = np.clip(np.floor(np.log(np.maximum(v, 1e-300) / 0.45) / np.log(RATIO)), 0, CELLS - 1).astype(int)
    small, large = np.zeros((5, CELLS)), np.zeros((5, CELLS))
    np.add.at(small, (b[p <= 0.45], cell[p <= 0.45]), 1)
    np.add.at(large, (b[p >= 0.55], cell[p >= 0.55]), 1)
    return b, cell, small, large, np.bincount(b[(p > 0.45) & (p < 0.55)], minlength=5)


V = 0.45 * RATIO ** (np.arange(CELLS) + 0.5)


def test_share_of_false_discoveries_and_power():
    rng, shares, found, plain = np.random.default_rng(2), [], [], []
    for _ in range(60):
        c, real, p = draw(rng)
        b, cell, *told = counts(c, p)
        level, _ = hypotheses.shrink(*told, V, 0.1)
        own = (p <= 0.45) & (cell >= level[b])
        shares.append((own & ~real).sum() / max(1, own.sum()))
        found.append((own & real).sum())
        order = np.sort(p)
        good = np.flatnonzero(order <= 0.1 * np.arange(1, len(p) + 1) / len(p))
        plain.append(((p <= order[good[-1]]) & real).sum() if len(good) else 0)
    assert np.mean(shares) < 0.1 + 2 * np.std(shares) / 60**0.5
    assert np.mean(found) > 1.05 * np.mean(plain)


def test_rounds_see_masked_pairs_only():
    """Swapping p and 1 - p of what stays masked leaves every round up to there as it was."""
    _, _, small, large, middle = counts(*(lambda c, _, p: (c, p))(*draw(np.random.default_rng(3))))
    level, path = hypotheses.shrink(small, large, middle, V, 0.1)
    kept = np.arange(CELLS)[None] >= level[:, None]
    _, other = hypotheses.shrink(np.where(kept, large, small), np.where(kept, small, large), middle, V, 0.1)
    assert len(path) > 20 and other[: len(path)] == path


def test_noise_selects_nothing():
    rng = np.random.default_rng(4)
    taken = 0
    for _ in range(40):
        c, p = rng.random(500), rng.random(500)
        b, cell, *told = counts(c, p)
        level, _ = hypotheses.shrink(*told, V, 0.1)
        taken += bool(((p <= 0.45) & (cell >= level[b])).any())
    assert taken <= 10


def test_in_spark(spark):
    c, _, p = draw(np.random.default_rng(5), 2000)
    rows = spark.createDataFrame([(k, float(a), float(x)) for k, (a, x) in enumerate(zip(c, p))] + [(9998, 0.9, None), (9999, None, 1e-9), (10000, 0.9, 0.0), (10001, 0.9, 1.0)], "v long, c double, p double")
    found = hypotheses.masked_thresholds(rows, "c").persist()
    got = {r["v"]: r for r in found.collect()}
    taken = [r for r in got.values() if r["selected"]]
    mirrored = sum(1 - r["p"] <= r["threshold"] for r in got.values() if r["p"] is not None)
    assert len(got) == 2004 and len(taken) > 50 and (1 + mirrored) / len(taken) <= 0.1 + 1e-9
    assert all(r["p"] <= r["threshold"] * (1 + 1e-9) for r in taken) and got[10000]["selected"] and not got[9998]["selected"] and not got[10001]["selected"]
    again = hypotheses.masked_thresholds(rows.repartition(5), "c").where("selected").select("v").collect()
    assert {r["v"] for r in again} == {r["v"] for r in taken}
    assert hypotheses.masked_thresholds(rows.where(F.lit(False)), "c").count() == 0
