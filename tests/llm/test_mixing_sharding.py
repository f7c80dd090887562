import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from lociframe.llm import mixing, sharding
from lociframe.llm.registry import op3_mixing, op10_sharding


def targets(sizes):
    """Water filling step by step: {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        got = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return got
        capped |= over


def test_mixing(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(docs[r.doc_id].text or ""))
        assert r.size == n and r.taken in (0, n, 2 * n)
        s = docs[r.doc_id].source
        sizes[s] += n
        taken[s] += r.taken
        longest[s] = max(longest[s], n)
    want = targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_mixing(spark, sf).repartition(3).collect()))


def test_cube_keeps_chances():
    hits, n = np.zeros(20), 4000
    sizes = [float(s) for s in range(1, 21)]
    for seed in range(n):
        rng, chances = random.Random(seed), [0.3] * 20
        at = mixing.fly(chances, sizes, rng)
        assert len(at) <= 2 and sum(chances) == pytest.approx(6.0) and sum(c * s for c, s in zip(chances, sizes)) == pytest.approx(63.0)
        mixing.land(chances, sizes, at, rng)
        assert set(chances) <= {0.0, 1.0}
        hits += chances
    assert np.all(np.abs(hits / n - 0.3) < 5 * (0.21 / n) ** 0.5)


def test_mixing_levels_and_odd(spark, odd, empty, monkeypatch):
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"), F.expr("if(id < 600, 's', null)").alias("source"))
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = mixing.mix_counts(many).collect()
    for size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == size]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 40 and size == sum(r.size for r in own)
    monkeypatch.undo()
    assert mixing.mix_counts(odd).count() == odd.count() and mixing.mix_counts(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_sharding(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shuffle_to_shards(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), 40).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.key, r.shard, r.slot) for r in again}


def test_sharding_odd(spark, odd, empty, tmp_path):
    rows = sharding.shuffle_to_shards(odd, 3).collect()
    assert len(rows) == odd.count() and sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]
    assert sharding.shuffle_to_shards(empty, 3).count() == 0
    sharding.write_shards(odd.select("doc_id", "text").dropDuplicates(["doc_id"]), f"{tmp_path}/out", 3)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_matrix():
    rng = np.random.default_rng(0)
    m = np.array(sharding.communication_matrix([5, 0, 7, 8], [7, 7, 6], 3))
    assert m.sum(0).tolist() == [7, 7, 6] and m.sum(1).tolist() == [5, 0, 7, 8]
    draws = [sharding._draw(rng, 10**9, 39 * 10**9, 4000) for _ in range(800)]
    assert abs(np.mean(draws) - 100) < 2 and abs(np.var(draws) - 97.5) < 20


def test_mix_of_repeated_rows(spark):
    rows = [(7, "one two three four", "en", "a", 18)] * 200 + [(None, "five six", "en", "a", 8)] * 100 + [(k, "seven eight nine", "en", "b", 16) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.source: r.target for r in mixing.mix_counts(docs).withColumn("source", F.when(F.col("source_size") == 1000, "a").otherwise("b")).select("source", "target").distinct().collect()}
    mixed = mixing.mix(docs).collect()
    for source in "ab":
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == source) - want[source]) <= 4
    assert sorted(map(tuple, mixed), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_large_draws():
    """Beyond numpy's limit: the walk's probability at the mode against exact fractions, and the draws' moments."""
    from fractions import Fraction

    choose = lambda n, k: math.comb(n, k)
    for good, bad, sample, x in ((60, 40, 30, 18), (400, 700, 90, 33), (30, 5000, 700, 4)):
        p = sample / (good + bad)
        got = sharding._binomial(x, good, p) * sharding._binomial(sample - x, bad, p) / sharding._binomial(sample, good + bad, p)
        assert got == pytest.approx(float(Fraction(choose(good, x) * choose(bad, sample - x), choose(good + bad, sample))), rel=1e-12)
    rng = np.random.default_rng(4)
    good, bad, sample = 3 * 10**9, 10**10, 10**6
    draws = np.array([sharding._draw(rng, good, bad, sample) for _ in range(300)])
    mean = sample * good / (good + bad)
    sd = math.sqrt(mean * bad / (good + bad) * (1 - sample / (good + bad)))
    assert abs(draws.mean() - mean) < 5 * sd / 300**0.5 and abs(draws.std() / sd - 1) < 0.2
    assert sharding._draw(rng, 10**9, 10**9, 2 * 10**9) == 10**9


def test_rows_that_repeat_are_spread(spark, monkeypatch):
    """A third of all rows is one row: no block, no part holds it whole, and splits don't matter."""
    from lociframe.llm import common, packing
    from lociframe.llm.registry import tokenizer_file

    same = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    other = spark.range(200_000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    docs = same.union(other)
    seen = []
    monkeypatch.setattr(mixing, "_level", lambda rows, *a, go=mixing._level: seen.append(rows.groupBy("source_h", "block").count().agg(F.max("count")).first()[0]) or go(rows, *a))
    rows = mixing.mix_counts(docs)
    assert max(seen) < 2 * mixing.BLOCK_ROWS and rows.count() == 300_000
    taken = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(taken - rows.first()["target"]) <= 3

    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h")).withColumn("value", F.col("h"))
    hashes = [
        common.told_apart(common.written(hashed.repartition(n).withColumn("split", F.spark_partition_id()), "t"), "value").agg(F.count_distinct("h"), F.sum(F.col("h").cast("decimal(38)"))).first()
        for n in (3, 11)
    ]
    assert hashes[0] == hashes[1] and hashes[0][0] == 300_000

    places = sharding.shuffle_to_shards(docs, 7)
    per = places.where("key = 7").groupBy("shard").count().collect()
    assert len(per) == 7 and max(r["count"] for r in per) < 16_000
    assert places.select("shard", "slot").distinct().count() == 300_000

    monkeypatch.setattr(packing, "PART_ROWS", 1000)
    packed = packing.pack(docs, tokenizer_file())
    assert packed.count() == 300_000 and packed.select("sequence_id", "offset").distinct().count() == 300_000
