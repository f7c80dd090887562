import random

import numpy as np
from brute import WORD, thue_morse

from lociframe.llm import near_dedup, shingles
from lociframe.llm.components import components
from lociframe.llm.registry import op4_near_dedup


def brute(texts, width=4):
    """{key: (size of the set, component)} by comparing all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in texts.items():
        w = WORD.findall((text or "").translate(lower))
        sets[key] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    inverse = {}
    for k, s in sets.items():
        for x in s:
            inverse.setdefault(x, []).append(k)
    pairs = {(a, b) for own in inverse.values() for a in own for b in own if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in texts}


def check(spark, path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    rows = op4_near_dedup(spark, str(path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts) and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)


def test_long_words_of_one_pattern(spark, tmp_path):
    texts = [f"{t}{tail}" for n in (1024, 2048, 4096, 65536) for t in thue_morse(n) for tail in ("", " two three")]
    assert len({s[0] for s in shingles.shingle_sets(texts, 5)}) == len(texts)
    check(spark, tmp_path, dict(enumerate(texts)))


def test_null_key_is_kept(spark, tmp_path):
    spark.createDataFrame([(None, "a b c d e"), (3, "x y z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.kept for r in op4_near_dedup(spark, str(tmp_path)).collect()} == {None: True, 3: True}


def test_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_dedup, "PART_ROWS", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = {}
    for size in (2, 3, 10, 150):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = word()
            texts[len(texts) * 3 + 1] = " ".join(own)
    notice = [word() for _ in range(60)]
    for _ in range(80):
        texts[len(texts) * 3 + 1] = " ".join([word() for _ in range(30)] + notice)
    texts |= {10_000: None, 10_001: "", 10_002: " \n", 10_003: "One two", 10_004: "one TWO", 10_005: "one", 10_006: "É é", 10_007: "é é"}
    keys = list(texts)
    rng.shuffle(keys)
    check(spark, tmp_path, {k: texts[k] for k in keys})


def test_superminhash():
    rng = np.random.default_rng(0)
    error = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = shingles.super_minhash([np.unique(pool[:250]), np.unique(pool[50:])], 240)
        error.append((a == b).mean() - 200 / 300)
    assert abs(np.mean(error)) < 0.015 and np.std(error) < (2 / 9 / 240) ** 0.5  # below MinHash's deviation
    one = shingles.super_minhash([pool[:1], pool[:0], np.sort(pool[:2])], 240)
    assert (one[0] != shingles.OPEN).all() and (one[1] == shingles.OPEN).all() and (one[2] != shingles.OPEN).all()
    assert len(np.unique(one[0] >> np.uint64(56))) == 240  # each slot in a round of its own


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100)] + [(500, 600 + k) for k in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        return k if parent[k] == k else find(parent[k])

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {k: find(k) for k in parent}


def test_odd(spark, odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component for r in rows if r.key == 4} == {4}
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(odd).columns == odd.columns


def test_null_and_repeated_keys(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (7, text), (7, text), (7, "quite another text of some length than the one above it"), (None, "only here with a null key and nowhere else at all"), (None, "only here with a null key and nowhere else at all")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, nth int")
    assert sorted(r.nth for r in near_dedup.keep_first(docs).collect()) in ([1, 3, 4], [1, 3, 5], [2, 3, 4], [2, 3, 5])
    assert sorted((r.key or 0, r.component or 0) for r in near_dedup.near_duplicates(docs).collect()) == [(0, 0), (0, 0), (0, 7), (7, 7), (7, 7), (7, 7)]


def test_size_classes(spark, tmp_path, monkeypatch):
    """One long shared passage and lengths that differ: buckets that the pivot doesn't settle."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(120)]
    texts = {}
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(rng.randint(5, 120))]
        texts[2 * k], texts[2 * k + 1] = " ".join(shared + own), " ".join(shared + own[:-1] + ["end"])
    check(spark, tmp_path, texts)
