"""SimHash near duplicates against all pairs, and the parts of the Gray-order index."""

import random
import re

import numpy as np
import pytest
import xxhash
from brute import WORD
from pyspark.sql import functions as F

from lociframe.llm import registry, simhash


def plain_fingerprint(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, low)
    if not words:
        return 0
    spans = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, most=4):
    """{key: smallest key reachable} for (key, fingerprint) pairs with distinct keys."""
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= most:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in rows}


def test_query(spark, sf):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_components(docs)
    rows = registry.op12_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{f:016x}", want[k]) for k, f in docs}
    assert len(rows) == len(docs)


def test_rank_is_that_of_the_gray_order(spark):
    codes = [k ^ (k >> 1) for k in range(300)]
    ranks = [r[0] + (1 << 63) for r in spark.createDataFrame([(c,) for c in codes], "fp long").select(simhash.gray_rank(F.col("fp"))).collect()]
    assert ranks == list(range(300))
    assert spark.createDataFrame([(-1,)], "fp long").select(simhash.gray_rank(F.col("fp"))).first()[0] + (1 << 63) == 0xAAAAAAAAAAAAAAAA


def clustered(n, seed):
    draw = random.Random(seed)
    codes = set()
    while len(codes) < n:
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 30])):
            codes.add(centre)
            centre ^= sum(1 << draw.randrange(64) for _ in range(draw.choice([1, 2, 4, 5, 6])))
            centre &= (1 << 64) - 1
    return sorted(codes)


def test_pairs_of_trees():
    own, other = (np.array(clustered(n, s), np.uint64) for n, s in ((1300, 1), (700, 2)))
    other = np.unique(np.concatenate([other, own[::50] ^ np.uint64(0x8000000000000101)]))
    rank = lambda codes: sorted(codes.tolist(), key=lambda c: int(bin(c)[2:].translate(""), 2))
    left, right = simhash.Tree(np.array(rank(own), np.uint64)), simhash.Tree(np.array(rank(other), np.uint64))
    found = {(int(left.codes[i]), int(right.codes[j])) for a, b in simhash.close_pairs(left, right, 4) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    x, y = np.nonzero(np.bitwise_count(left.codes[:, None] ^ right.codes[None]) <= 4)
    assert found == {(int(left.codes[i]), int(right.codes[j])) for i, j in zip(x, y, strict=True)} and found


def test_forest_keeps_components():
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(350)]
    a, b = simhash.forest(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    assert len(a) < 400 and (a < b).all()
    small = lambda pairs: {k: min(c) for c in joined(pairs) for k in c}

    def joined(pairs):
        groups = []
        for x, y in pairs:
            mine = [g for g in groups if x in g or y in g]
            groups = [g for g in groups if g not in mine] + [set().union({x, y}, *mine)]
        return groups

    want = {k: v for k, v in small(links).items()}
    got = small(list(zip(a.tolist(), b.tolist(), strict=True)))
    assert all(got.get(k, k) == v for k, v in want.items())


@pytest.mark.parametrize("block,fan", [(64, 2), (100, 4)])
def test_many_blocks(spark, monkeypatch, block, fan):
    """Blocks and upper nodes of small size: several levels, the same components."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIECE", 16)
    monkeypatch.setattr(simhash, "FAN", fan)
    monkeypatch.setattr(simhash, "PART_BLOCKS", 2)
    codes = clustered(1500, 4)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    want = plain_components(list(zip(signed, codes, strict=True)))
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()]
    root = {c: c for c in signed}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {c: find(c) for c in signed} == want


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_key = {r["key"]: r for r in rows}
    assert {by_key[k]["fp"] for k in (1, 2, 7)} == {0} and {by_key[k]["component"] for k in (1, 2, 7)} == {1}
    assert by_key[3]["fp"] & ((1 << 64) - 1) == xxhash.xxh64_intdigest(b"one", 42)
    assert by_key[None]["component"] is None
    assert [r["component"] for r in rows if r["key"] == 4] == [4, 4]
    assert simhash.near_duplicates(empty).count() == 0
    long = "a b c d " * 40_000
    assert simhash.fingerprint_of(long) == plain_fingerprint(long)
