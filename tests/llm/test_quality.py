import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from lociframe.llm import quality_model, quality_rules
from lociframe.llm.registry import op7_quality_model


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality_model(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 50 and np.mean([p == y for p, y in own]) > 0.9
    assert rows == op7_quality_model(spark, sf).collect()


def test_features_and_scores_agree():
    texts = ["ab ab cd", "", None, "é" * 3, "one two  two\nthree", "x"]
    rng = np.random.default_rng(1)
    model = quality_model.Model(rng.normal(size=quality_model.BUCKETS).astype(np.float32), 0.25)
    want = [1 / (1 + np.exp(-(float(t @ model.weights[b]) + 0.25))) for b, t in quality_model.counts(texts)]
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_odd_model(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1), (99, 1), (4, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd, labels)
    assert quality_model.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert quality_model.score(empty, quality_model.fit(empty, labels)).count() == 0
    assert quality_model.fit(odd, labels.where("quality = 1")).scores([""])[0] > 0.99


def test_rules_odd(spark, odd, empty):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == odd.count() and quality_rules.quality_rules(empty).count() == 0
    assert {r.key: r.n_dup_lines for r in rows}[8] == 49 and {r.key: r.n_repeat_words for r in rows}[8] == 50
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_frequent_lines(spark):
    line, tail = "This line is on every page of the host", "of some text that is only here and nowhere else"
    rows = [(k, f"{line}\nand page number {k} {tail} as far as I know", "h") for k in range(60)]
    rows += [(100 + k, f"  this LINE is on every page  of the host\nbye {k} and {k}", "h") for k in range(3)]
    rows += [(200 + k, f"{line}\n{line} twice {k} {k} {k} {k}", "other") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.key: r for r in quality_rules.quality_rules(frame).collect()}
    assert all(got[k].kept and got[k].removed_words == 9 for k in range(60))
    assert all(got[100 + k].depleted and not got[100 + k].kept for k in range(3)) and all(got[200 + k].removed_words == 0 for k in range(3))
    copies = spark.createDataFrame([(k, f"{line}\n{tail}", "h") for k in range(60)], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(copies).where(F.col("kept")).count() == 60


def test_lines_removed(spark):
    line, tail = "This line is on every page of the host", "of some text that is only here and nowhere else"
    rows = [(k, f"{(line, ' THIS line is on every page  of the host')[k % 2]}\n\n number {k} {tail} as far as I know\nend {k}\n", "h") for k in range(60)]
    rows += [(200 + k, f"{line}\nnumber {k} {tail}\n", "other") for k in range(3)]
    rows += [(300, f"{line}\nnumber 300 {tail}\n", None), (301, f"{line}\nbye", "h"), (1, f"{line}\nnumber 1 again {tail}", "other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source): r.text for r in quality_rules.keep_good(frame).collect()}
    want = {(k, "h"): f"\n number {k} {tail} as far as I know\nend {k}\n" for k in range(60)}
    assert got == want | {(k, host): text for k, text, host in rows if host != "h"}


def test_pipeline_writes_cleaned_text(spark, sf):
    line = "This line is on every page of the host"
    rows = [(k, f"{line}\npage {k} of some text that is only here and nowhere else", "en", "h", 0) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["quality"](spark, frame, sf)
    got = out.collect()
    assert len(got) == 60 and out.schema == frame.schema
    assert all(line not in r.text and r.text.startswith("page ") and r.n_chars == len(r.text) for r in got)


def test_repeated_rows_and_keys(spark):
    line, tail = "This line is on every page of the host", "of some text that is only here and nowhere else"
    rows = [(k, f"{line}\nnumber {k} {tail} as far", "h") for k in range(40)]
    rows += [(500, f"{line}\nthe text {tail} as it is", "h")] * 4
    rows += [(None, f"{line}\nno key {tail}", "h"), (600, f"{line}\nsix {tail}", "h"), (600, f"{line}\nbye", "h"), (600, "too short", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.quality_rules(frame).collect()
    assert [(r.kept, r.removed_words) for r in got if r.key == 500] == [(True, 9)] * 4
    assert sorted((r.kept, r.removed_words) for r in got if r.key == 600) == [(False, 0), (False, 9), (True, 9)]
    kept = [(r.doc_id, r.text) for r in quality_rules.keep_good(frame).collect()]
    assert kept.count((500, f"the text {tail} as it is")) == 4 and kept.count((None, f"no key {tail}")) == 1
    assert [t for k, t in kept if k == 600] == [f"six {tail}"]


def test_limit_whatever_the_share(spark):
    line = "This line is on some pages of a large host"
    rows = [(k, f"{line} here\npage {k} of it" if k % 4 == 0 else f"page {k} of it alone", "h") for k in range(200)]
    counts = quality_rules.text_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    found = lambda **limits: quality_rules.frequent_lines(counts, **limits).collect()
    assert not found(max_share=0.5) and [(r.n_texts, r.n_docs) for r in found(max_share=0.5, many_docs=40)] == [(50, 50)]


def test_features_by_hand():
    """Words, character n-grams with one mark on either side, and pairs of neighbours, counted in plain Python."""
    texts = ["né né x\n\t y", "", "a", " ab  "]
    for (bucket, share), text in zip(quality_model.counts(texts), texts):
        words = text.split()
        grams = [f" {w} "[i : i + n] for w in words for n in quality_model.NGRAMS for i in range(len(w) + 3 - n)]
        total = 2 * len(words) + len(grams)
        assert np.isclose(share.sum(), 1) or not words
        assert len(bucket) <= total and sorted(np.round(share * total).tolist(), reverse=True)[:1] <= [total]
        if text.startswith("né"):
            shares = dict(zip(bucket.tolist(), np.round(share * total).astype(int).tolist()))
            assert shares[0] == 3 and shares[1] == 1 and sum(shares.values()) == total


def test_training_learns_the_gradient():
    """On separable rows the loss falls to almost nothing, and flipped labels give the opposite model."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(400):
        y = k % 2
        bucket = np.sort(rng.choice(np.arange(100), 10, replace=False)) + 100 * y + 2
        rows.append((bucket.astype(np.uint16), np.full(10, 0.1, np.float32)))
        labels.append(y)
    odds = lambda model: np.array([float(t @ model.weights[b]) + model.bias for b, t in rows])
    right, wrong = odds(quality_model.train(rows, labels)), odds(quality_model.train(rows, [1 - y for y in labels]))
    y = np.array(labels)
    assert np.mean(np.log1p(np.exp(np.where(y == 1, -right, right)))) < 0.05
    assert ((right > 0) == (y == 1)).all() and ((wrong > 0) == (y == 0)).all()


def test_training_bound(spark):
    docs = spark.createDataFrame([(k % 50, f"word{k % 50} some more words") for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    seen = []
    train = quality_model.train
    try:
        quality_model.train = lambda rows, y: seen.append(len(rows)) or train(rows, y)
        quality_model.fit(docs, labels)
        quality_model.fit(docs, labels, most_features=400)
        quality_model.fit(docs, labels, most_rows=7)
    finally:
        quality_model.train = train
    assert seen[0] == 50 and 0 < seen[1] < 50 and seen[2] == 7
