import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from brute import WORD, base_spans
from test_mixing_sharding import targets
from test_near_dedup import brute as components
from test_tokens import tokenizer  # noqa: F401

from lociframe.llm import quality_rules


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(input, output) of each stage, as lists of rows."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        new = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, new
        docs = new
    return out


def judged(rows):
    """{(doc_id, text): text without boilerplate, or None if rejected} by plain Python over (doc_id, source, text)."""
    words = lambda t: WORD.findall(t or "")
    clean = lambda line: " ".join(words(line)).lower()
    holders, sizes = defaultdict(set), defaultdict(set)
    for _, source, text in rows:
        sizes[source].add(text)
        for line in (text or "").split("\n"):
            if words(line):
                holders[source, clean(line)].add(text)
    out = {}
    for key, source, text in rows:
        w = words(text)
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        covered = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(5)}
        bad = lambda line: words(line) and (n := len(holders[source, clean(line)])) > 20 and (n > 0.02 * len(sizes[source]) or n > 5000)  # noqa: E731, B023
        gone = [line for line in (text or "").split("\n") if bad(line)]
        left = len(w) - sum(len(words(line)) for line in gone)
        rejected = len(w) < 10 or 100 * len(covered) > 20 * len(w) or bool(gone) and (left < 5 or left < 0.2 * len(w))
        out[key, text] = None if rejected else "\n".join(line for line in text.split("\n") if not bad(line)) if gone else text
    return out


def test_quality(stages):
    docs, kept = stages["quality"]
    want = judged([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in kept.collect()} == {k: t for (k, _), t in want.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in kept.collect()) and kept.columns == docs.columns
    assert {r.key for r in quality_rules.quality_rules(docs).where("kept").collect()} == {k for (k, _), t in want.items() if t is not None}


def test_quality_on_shared_lines(spark):
    """Boilerplate in part of a host's pages, a page of nothing else, and another host that has it too."""
    line = "Read more about us on our other page"
    rows = [(k, "en", "h", f"{line}\nPage number {k} says a thing of its own and then one more {k}" if k % 2 else f"Page number {k} says a thing without it and then one more {k} here") for k in range(80)]
    rows += [(100, "en", "h", f"{line}\n{line}\nbye now"), (101, "en", "g", f"{line}\nThis host has it once only as far as we know")]
    docs = spark.createDataFrame([(k, t, lang, s, len(t)) for k, lang, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, "").collect()}
    assert got == {k: t for (k, _), t in judged([(k, s, t) for k, _, s, t in rows]).items() if t is not None}
    assert 100 not in got and line in got[101] and not any(line in got[k] for k in range(80))


def test_near_duplicates(stages):
    docs, kept = stages["near_duplicates"]
    want = components({r.doc_id: r.text for r in docs.collect()}, width=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    assert kept.schema == docs.schema


def test_personal_data(stages):
    docs, masked = stages["personal_data"]
    before = {r.doc_id: r for r in docs.collect()}
    for r in masked.collect():
        assert not any(base_spans(r.text).values()) and r.n_chars == len(r.text)
        if not any(base_spans(before[r.doc_id].text).values()) and "<" not in r.text:
            assert r == before[r.doc_id]
    assert masked.schema == docs.schema and masked.count() == docs.count()


def test_mixture(stages):
    docs, mixed = stages["mixture"]
    n = Counter(r.doc_id for r in mixed.collect())
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        source[r.source] += size[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
        taken[r.source] += size[r.doc_id] * n[r.doc_id]
    assert max(n.values()) <= 2 and mixed.schema == docs.schema
    assert all(abs(taken[s] - want) <= longest[s] for s, want in targets(source).items())


def test_packed(stages, tokenizer):  # noqa: F811
    docs, rows = stages["packed"]
    copies, texts = Counter(r.doc_id for r in docs.collect()), {r.doc_id: r.text for r in docs.collect()}
    pieces = rows.collect()
    assert Counter((r.doc_id, r.piece) for r in pieces) == Counter({(k, p): copies[k] for k, t in texts.items() for p in range(math.ceil((len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) / 2048))})
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    by = defaultdict(list)
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1.01 * sum(r.length for r in pieces) / 2048 + 2


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_and_empty(spark, odd, empty, sf):
    odd = odd.selectExpr("*", "'clash' as kept_key", "'clash' as component", "'clash' as member")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packed":
                assert out.columns == docs.columns, name
            if docs is empty:
                assert not rows, name
            elif name == "quality":
                assert {r.doc_id for r in rows} == {k for (k, _), t in judged([(r.doc_id, r.source, r.text) for r in docs.collect()]).items() if t is not None}, name
            elif name == "near_duplicates":
                assert len(rows) <= docs.count(), name
            elif name == "personal_data":
                assert len(rows) == docs.count()
