import time
import tracemalloc

import numpy as np
import pytest

from lociframe import cli
from lociframe.operators import genetics_extra, prefix_copying


def panel(n, m, founders, seed=0, holes=0.05):
    """Samples that switch between founders about every 25 sites."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, (founders, m)).astype(float)
    g = np.empty((n, m))
    for s in range(n):
        at = rng.integers(founders)
        for k in range(m):
            at = rng.integers(founders) if rng.random() < 0.04 else at
            g[s, k] = base[at, k]
    return g, np.where(rng.random((n, m)) < holes, np.nan, g)


def test_neighbours_are_longest_matches():
    rng = np.random.default_rng(2)
    calls = rng.integers(0, 3, (17, 12))
    calls[5] = calls[9]
    who, length = prefix_copying.neighbours(calls, 2)
    for k in range(12):
        def match(a, b, k=k):
            same = calls[a, : k + 1] == calls[b, : k + 1]
            return k + 1 if same.all() else k - np.flatnonzero(~same)[-1]

        for s in range(17):
            real = sorted((match(s, b) for b in range(17) if b != s), reverse=True)
            near = [(w, l) for w, l in zip(who[k, s], length[k, s], strict=True) if w >= 0]
            assert all(match(s, w) == l for w, l in near) and max(l for _, l in near) == real[0]


def test_all_states_are_the_whole_model():
    _, g = panel(14, 30, 3)
    g[:, 4] = np.nan
    assert np.allclose(prefix_copying.posterior(g, 13), genetics_extra.copying_posterior(g))
    assert np.allclose(prefix_copying.posterior(g, 500), genetics_extra.copying_posterior(g))


def test_few_states_find_the_founders():
    truth, g = panel(300, 120, 12)
    gone = np.isnan(g)
    whole = np.abs(genetics_extra.copying_posterior(g) - truth)[gone].mean()
    assert whole < 0.2 * np.abs(np.broadcast_to(np.nanmean(g, axis=0), g.shape) - truth)[gone].mean()
    for states, slack in ((50, 1.05), (20, 1.3)):
        few = prefix_copying.posterior(g, states)
        assert not np.isnan(few).any() and np.array_equal(few[~gone], g[~gone])
        assert np.abs(few - truth)[gone].mean() < slack * whole


def test_cost_grows_with_samples():
    took = []
    for n in (400, 1600):
        _, g = panel(n, 40, 12)
        start = time.process_time()
        prefix_copying.posterior(g, 20)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]  # four times the samples; the square would be sixteen times


def test_memory_is_a_few_numbers_a_call():
    """Neighbours and states of all samples at all sites are never held at once."""
    took = []
    for n in (4000, 16_000):
        g = np.random.default_rng(1).integers(0, 3, (n, 10)).astype(float)
        g[::40, 3] = np.nan
        tracemalloc.start()
        done = prefix_copying.posterior(g, 50)
        took.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert not np.isnan(done).any()
    assert took[1] - took[0] < 12_000 * 10 * 120  # 120 bytes a call; it took 290 with the neighbours at all sites


def test_windows_of_samples_in_tiles(spark, monkeypatch):
    """Tiles of samples, holes as missing rows, and positions that two variants share."""
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (40, 12)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    cells = spark.createDataFrame([(j, 7 * i, float(g[i, j])) for i in range(40) for j in range(12) if not np.isnan(g[i, j])], "v_idx long, s_idx long, dosage double")
    variants = spark.createDataFrame([(j, "1", 1000 * (j // 2)) for j in range(12)], "v_idx long, chr string, pos long")
    want = np.column_stack([prefix_copying.posterior(g[:, a : a + 4], 8) for a in (0, 4, 8)])
    for tile in (50, 1 << 16):
        monkeypatch.setattr(prefix_copying, "TILE", tile)
        rows = {(r.v_idx, r.s_idx): r.dosage for r in prefix_copying.impute(cells, variants, 8, window=2000).collect()}
        assert len(rows) == 480 and all(rows[j, 7 * i] == pytest.approx(want[i, j]) for i in range(40) for j in range(12))


def test_edges(spark):
    assert np.allclose(prefix_copying.posterior(np.array([[1.0, np.nan]]), 5), [[1.0, 0.0]])
    assert np.allclose(prefix_copying.posterior(np.full((4, 3), np.nan), 2), 0)
    _, g = panel(30, 20, 4)
    cells = spark.createDataFrame([(j, i, None if np.isnan(g[i, j]) else float(g[i, j])) for i in range(30) for j in range(20)], "v_idx long, s_idx long, dosage double")
    variants = spark.createDataFrame([(j, "1", 1000 * j) for j in range(20)], "v_idx long, chr string, pos long")
    rows = {(r.v_idx, r.s_idx): r.dosage for r in prefix_copying.impute(cells, variants, 8).collect()}
    want = prefix_copying.posterior(g, 8)
    assert len(rows) == 600 and all(rows[j, i] == pytest.approx(want[i, j]) for i in range(30) for j in range(20))
    assert prefix_copying.impute(cells.limit(0), variants).count() == 0


def test_command(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = [f"i{k}" for k in range(20)]
    body = "".join(f"1\t{1000 * (k + 1)}\trs{k}\tA\tG\t.\tPASS\t.\tGT\t" + "\t".join("./." if rng.random() < 0.1 else ["0/0", "0/1", "1/1"][rng.integers(3)] for _ in ids) + "\n" for k in range(15))
    (tmp_path / "g.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(ids) + "\n" + body)
    cli.main(["impute", "--genotypes", str(tmp_path / "g.vcf"), "--method", "prefix", "--out", str(tmp_path / "out")], spark)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 300 and done.where("dosage is null").count() == 0
