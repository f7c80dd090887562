"""Cuts of least LD against all ways to cut."""

import itertools

import numpy as np
import pytest

from lociframe.operators import bayes, ld_cuts


def brute(cost, least, most):
    """The least total over all sets of cuts; the last block may be short."""
    n = len(cost)
    best = np.inf
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            sizes = np.diff([0, *cuts, n])
            if (sizes[:-1] >= least).all() and (sizes <= most).all():
                best = min(best, sum(cost[c - 1] for c in cuts))
    return best


def test_best_cuts():
    rng = np.random.default_rng(0)
    for n, least, most in [(1, 1, 1), (1, 5, 9), (11, 2, 4), (12, 3, 5), (12, 1, 12), (10, 4, 4), (9, 2, 3)]:
        for _ in range(6):
            cost = rng.random(n).round(1)
            ends = ld_cuts.best_cuts(cost, least, most)
            sizes = np.diff([0, *ends])
            assert ends[-1] == n and (sizes[:-1] >= least).all() and (sizes <= most).all() and (sizes > 0).all()
            assert abs(sum(cost[e - 1] for e in ends[:-1]) - brute(cost, least, most)) < 1e-9


def linked(spark, sizes, gap=0.0):
    """Variants in runs with r of 0.8 inside and ``gap`` between neighbouring runs; v_idx does not follow the position."""
    n = sum(sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    names = np.random.default_rng(1).permutation(n)
    variants = spark.createDataFrame([(int(names[k]), "c1" if k % n >= 0 else "", 100 + 10 * k) for k in range(n)], "v_idx long, chr string, pos long")
    pairs = [(int(names[a]), int(names[b]), 0.8 if run[a] == run[b] else gap) for a in range(n) for b in range(a + 1, n) if run[b] - run[a] <= 1]
    return variants, spark.createDataFrame(pairs, "i long, j long, r double"), {int(names[k]): int(run[k]) for k in range(n)}


def test_runs_are_found(spark):
    variants, pairs, run = linked(spark, [7, 12, 5, 13, 14], gap=0.1)
    rows = ld_cuts.blocks(variants, pairs, 4, 16).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, set()).add(run[r.v_idx])
    assert len(blocks) == 5 and all(len(own) == 1 for own in blocks.values())
    assert sum(r.cost for r in rows) == pytest.approx(sum(a * b for a, b in [(7, 12), (12, 5), (5, 13), (13, 14)]) * 0.01)


def test_costs(spark):
    variants, pairs, _ = linked(spark, [3, 4], gap=0.5)
    costs = [r.cost for r in ld_cuts.cut_costs(variants, pairs).orderBy("place").collect()]
    run, want = [0, 0, 0, 1, 1, 1, 1], []
    for cut in range(1, 8):
        want.append(sum(0.64 if run[a] == run[b] else 0.25 for a in range(cut) for b in range(cut, 7)))
    assert np.allclose(costs, want)


def test_odd_tables(spark):
    variants = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 1)], "v_idx long, chr string, pos long")
    pairs = spark.createDataFrame([(1, 3, 0.9), (2, 1, None)], "i long, j long, r double")
    assert {r.v_idx: (r.block, r.cost) for r in ld_cuts.blocks(variants, pairs, 1, 9).collect()} == {1: ("a:0", 0.0), 2: ("a:1", 0.0), 3: ("b:0", 0.0)}
    assert ld_cuts.blocks(variants.limit(0), pairs, 1, 9).count() == 0
    with pytest.raises(ValueError, match="least"):
        ld_cuts.blocks(variants, pairs, 5, 4)


def test_block_methods_refuse_large_blocks(spark, monkeypatch):
    variants, pairs, _ = linked(spark, [6, 6])
    stats = variants.selectExpr("v_idx", "chr AS block", "double(v_idx) AS z", "100.0D AS n")
    monkeypatch.setattr(bayes, "MOST_VARIANTS", 8)
    with pytest.raises(ValueError, match="block c1 has 12 variants"):
        bayes.finemap(stats, pairs)
    cut = stats.drop("block").join(ld_cuts.blocks(variants, pairs, 4, 8).select("v_idx", "block"), "v_idx")
    assert bayes.finemap(cut, pairs).select("block").distinct().count() == 2


def test_sample_sizes_are_not_made_up(spark, tmp_path):
    from lociframe import cli
    from lociframe.sources.readers import Genotypes

    variants = spark.createDataFrame([(0, "rs0", "1", 10, "A", "G"), (1, "rs1", "1", 20, "C", "T")], "v_idx long, snp string, chr string, pos long, a1 string, a2 string")
    panel = Genotypes(variants, spark.createDataFrame([], "v_idx long, iid string, dosage double"))
    path = tmp_path / "s.tsv"
    path.write_text("SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\nrs0\t1\t10\tA\tG\t0.1\t0.1\t0.3\nrs1\t1\t20\tT\tC\t0.2\t0.1\t0.05\n")
    with pytest.raises(SystemExit, match="--n"):
        cli._stats_of(spark, panel, str(path))
    rows = {r.v_idx: (round(r.z, 6), r.n) for r in cli._stats_of(spark, panel, str(path), 500.0).collect()}
    assert set(rows.values()) <= {(1.0, 500.0), (2.0, 500.0), (-2.0, 500.0)} and rows[0] == (1.0, 500.0)
