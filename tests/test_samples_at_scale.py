"""Queries on more samples than a driver's matrix holds."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__
from lociframe.operators import kinship, ld
from lociframe.plans import views


@pytest.mark.parametrize("name", ["vanraden", "loco", "yang", "dominance", "su", "slater", "pseudo_diploid"])
def test_relationship_tables_pass_the_driver_by(spark, sf, monkeypatch, name):
    monkeypatch.setattr(kinship, "MOST_SAMPLES", 5)
    assert __spark_entry__.queries()[f"grm_{name}"](spark, sf).count() == 55


def test_tiles_move_no_matrix_where_a_task_has_the_whole_pair(spark, sf):
    ids = [r["s_idx"] for r in views.samples(spark, sf).orderBy("s_idx").collect()]
    rows = kinship.encoded(views.geno(spark, sf)).localCheckpoint()
    plan = lambda tile: kinship.tiles(rows, ids, tile)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(2).count("RepartitionByExpression") == 1  # 15 pairs for 8 tasks
    assert plan(1024).count("RepartitionByExpression") == 2
    whole = {(r.i, r.j): r.k for r in kinship.gram_pairs(rows, ids).collect()}
    parts = {(r.i, r.j): r.k for r in kinship.gram_pairs(rows, ids, 2).collect()}
    assert whole.keys() == parts.keys() and np.allclose(list(whole.values()), [parts[k] for k in whole])
    far = {k for k, v in whole.items() if k[0] == k[1] or abs(v) >= 0.1}
    assert {(r.i, r.j) for r in kinship.sparse_pairs(rows, 0.1, ids, 2).collect()} == far


def test_values_of_many_levels_are_packed_as_they_are():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 3, (4, 1000)) - 0.3, rng.standard_normal((4, 300)), np.zeros((0, 5))):
        assert np.array_equal(kinship._decoded(*kinship._coded(x), *x.shape), x)


def test_nearest_others_are_those_of_all_pairs(spark, sf, monkeypatch):
    """Stripes, tiles and chunks of variants of any size, and copies whose ties go to the smaller sample; no pair becomes a row."""
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (70, 300)).astype(float)
    g[40:] = g[:30]  # copies
    g[rng.random(g.shape) < 0.1] = np.nan
    g[60:] = g[:10]
    cells = spark.createDataFrame([(v, 3 * s, None if np.isnan(g[s, v]) else float(g[s, v])) for v in range(300) for s in range(70)], "v_idx long, s_idx long, dosage double")
    rows = kinship.encoded(cells).localCheckpoint()
    x = np.nan_to_num(g - np.nanmean(g, axis=0))
    p = np.nanmean(g, axis=0) / 2
    k = np.round(x @ x.T / (2 * p * (1 - p)).sum(), 9)
    np.fill_diagonal(k, -np.inf)
    want = {(3 * s, 3 * int(o)): k[s, o] for s in range(70) for o in np.lexsort((np.arange(70), -k[s]))[:4]}
    for stripes, block, wide in ((1, 1 << 22, 256), (3, 70, 256), (5, 1, 64)):
        monkeypatch.setattr(kinship, "BLOCK", block)
        monkeypatch.setattr(kinship, "WIDE", wide)
        got = {(r.s_idx, r.other): r.w for r in kinship.nearest(rows, 4, 70, stripes=stripes).collect()}
        assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a], abs=2e-9) for a in want)
    assert kinship.nearest(rows.where("s_idx < 6"), 4).count() == 2
    assert kinship.nearest(rows.limit(0), 4).count() == 0
    monkeypatch.setattr(kinship, "gram_pairs", None)
    assert __spark_entry__.queries()["impute_knn"](spark, sf).where("dosage IS NOT NULL").count() == 2000


def test_tasks_of_pairs_hold_a_small_tile(spark):
    """No group of `ld` has more than some ten thousand samples of a variant; tiles add up to the same correlations."""
    calls = spark.range(40_000).selectExpr("id % 2 AS v_idx", "id AS s_idx", "CAST((id * 7 + id DIV 11) % 3 AS DOUBLE) AS dosage")
    calls = calls.unionByName(calls.selectExpr("1 - v_idx AS v_idx", "s_idx", "CAST((s_idx * 5 + s_idx DIV 13) % 3 AS DOUBLE) AS dosage"))
    variants = spark.createDataFrame([(0, "1", 10), (1, "1", 20)], "v_idx long, chr string, pos long")
    assert max(len(r.s) for r in ld._tiled(calls, variants, 100, ld.TILE).select("s").collect()) <= 16_384
    assert ld.pair_correlations(calls, variants, 100).collect() == ld.pair_correlations(calls, variants, 100, 1 << 20).collect()
