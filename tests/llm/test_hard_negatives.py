"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.llm import hard_negatives, registry


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """Rows (id, label, vector of whole numbers); returns sorted result tuples."""
    out = []
    for q, label, v in rows:
        if not anchors(q):
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), -i, i, other) for i, other, w in rows if i != q), reverse=True)
        for s, _, i, other in [x for x in scored if x[3] == label][:positives]:
            fits = [(t, j) for t, _, j, o in scored if o != label and low * s <= 100 * t <= high * s][:negatives]
            out += [(q, i, rank, j, s, t) for rank, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def sample(n, dims, labels, seed, centres=5):
    draw = random.Random(seed)
    middle = [[draw.randint(-90, 90) for _ in range(dims)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = draw.choice(middle)
        rows.append((i, draw.choice(labels), [x + draw.randint(-25, 25) for x in c] if i % 3 else list(c)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "id long, label long, v array<double>")


def test_query(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r["label"] is None or r["embedding"] is None or not all(x is not None and math.isfinite(x) for x in r["embedding"]):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, [math.floor(256 * x) for x in r["embedding"]]))
    want = plain(rows, lambda i: i % 100 == 0)
    assert got(registry.op11_hard_negatives(spark, sf)) == want and want


@pytest.mark.parametrize("cell,group,chunk", [(40, 4, 16), (200, 1000, 4096)])
def test_cells_and_groups(spark, monkeypatch, cell, group, chunk):
    """Many small cells, ties and copies; a label that holds most rows."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "STEP", 500)
    rows = sample(600, 3, [1, 1, 1, 1, 2, 3, -4], 7)
    asked = lambda i: i % 13 == 0
    assert got(hard_negatives.hard_negatives(frame(spark, rows), F.col("id") % 13 == 0)) == plain(rows, asked)


def test_cells_are_pruned(spark, monkeypatch):
    """Where clusters lie far apart, a group asks few of the other cells for anything."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 20)
    draw = random.Random(5)
    rows = [(i, i % 2, [1000 * (i % 8 == k) + draw.randint(0, 20) for k in range(8)]) for i in range(800)]
    own = hard_negatives.written(frame(spark, rows), "rows")
    space = hard_negatives._space(own)
    placed = hard_negatives.written(hard_negatives._placed(own, space, F.col("id") % 10 == 0), "placed")
    anchors = hard_negatives._grouped(placed, space)
    ends = anchors.withColumns({"least": F.lit(900_000.0), "most": F.lit(1e15)})
    near, far = (hard_negatives._asked(ends, space, k).count() for k in (True, False))
    groups = anchors.select("grp").distinct().count()
    assert near + far < 0.7 * groups * len(space.pivots)


def test_positives_with_scores_of_any_sign(spark):
    rows = [(0, 1, [10, 0]), (1, 1, [-5, 3]), (2, 1, [0, 7]), (3, 2, [-2, 0]), (4, 2, [0, -1]), (5, 1, [8, 8]), (6, 2, [4, 1]), (7, 2, [4, 9]), (100, 9, [1, 1])]
    asked = lambda i: i % 100 == 0
    assert got(hard_negatives.hard_negatives(frame(spark, rows), F.col("id") % 100 == 0)) == plain(rows, asked)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, v string, cell int, grp int"
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, None, 1), (3, [1.0, None], 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [0.5, 0.5], None),
        (None, [1.0, 1.0], 2), (8, [], 2), (9, [0.5], 2), (10, [0.5, 0.5, 0.0], 2), (11, [-0.001, 0.0], 2),
    ]
    table = spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], schema)
    whole = hard_negatives.whole_vectors(table)
    assert {r["id"]: r["v"] for r in whole.collect()} == {0: [256, 128], 1: [256, 64], 8: [], 9: [128], 10: [128, 128, 0], 11: [-1, 0]}
    # 0.1: 256 * 256 + 128 * 64 = 73728; negatives from 22118.4 to 66355.2
    assert got(hard_negatives.hard_negatives(whole, F.col("id") == 0)) == [(0, 1, 1, 10, 73728, 49152), (0, 1, 2, 9, 73728, 32768)]
    none = table.limit(0)
    assert got(hard_negatives.hard_negatives(hard_negatives.whole_vectors(none), F.col("id") == 0)) == []
    assert got(hard_negatives.hard_negatives(whole, F.lit(False))) == []
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.hard_negatives(frame(spark, [(1, 1, [1e9])]), F.lit(True))
