"""Source divergence against plain Python."""

import re
from collections import Counter, defaultdict

from lociframe.llm import divergence, registry

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least=3, best=200):
    """docs: (lang, source, text); the rows of the result."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    seen, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall(low(text))
        groups[lang].add(source)
        n[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in seen[lang].items() if c >= least]

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + len(kept)) for t in kept}

        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        own = {s: shares(n[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(own[s][t], whole[t]), t.encode(), t) for t in kept if n[lang, s][t] and own[s][t] > whole[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query(spark, sf):
    docs = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(registry.op13_source_divergence(spark, sf)) == plain(docs)


def test_odd_rows(spark, odd, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert got(divergence.divergence(odd)) == plain(rows)
    assert got(divergence.divergence(empty)) == []


def test_null_names_and_languages_without_terms(spark):
    docs = [(None, None, "Été ete\x00été ÉTÉ"), ("", None, "ete été"), ("", "a", "ete x1y ete été"), (None, "b", None), ("de", "a", "nur hier"), ("de", "b", ""), ("de", "c", "dort")] * 1
    docs += [("en", f"s{k % 7}", "the " * k + f"word{chr(97 + k % 5)} " + "tail" * (k % 2)) for k in range(40)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    want = plain(docs)
    assert got(divergence.divergence(frame)) == want
    assert {v for lang, _, part, _, v, _ in want if lang == "de"} == {0}


def test_small_shards_and_flushes(spark, monkeypatch):
    """Counts flushed often and shards that add up while they read give the same."""
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 8)
    docs = [("en" if k % 3 else "fr", f"s{k * k % 5}", f"common word{k % 9} Other{k % 4} common rare{k}") for k in range(120)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    assert got(divergence.divergence(frame)) == plain(docs)
