from brute import base_digest

from lociframe.llm import pii
from lociframe.llm.registry import op6_pii


def test_matches_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want, told = base_digest(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_hard_texts(spark, tmp_path):
    texts = [
        "a@b.c_d@e.f", "a" * 50_000, "1" * 50_000, "1 " * 20_000, "a@b" + ".c" * 20_000, "+1" * 9_000, "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4",
        "é" * 500 + " 4111-1111-1111-1111, a.b@c.d x@y.z" * 700, "\U0001f600+1 (743) 555-3824)", "99999999999999.1.1.1", None, "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op6_pii(spark, str(tmp_path)).collect():
        want, _ = base_digest(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id][:50]


def test_other_kinds(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 here", "iban GB83 WEST 1234 5698 7654 32 here", "my ssn is 123-45-6789", "code 123-45-6789", 'token = "' + "ab12" * 10 + '"', "hash " + "ab12" * 10]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("key").collect()
    assert [[len(r[k]) for k in ("iban", "ssn", "secret")] for r in rows] == [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1], [0, 0, 0]]


def test_redact(spark, odd, empty):
    rows = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert rows[6] == "é \U0001f600 <EMAIL> <IP> <CARD> <PHONE>" and rows[1] is None and rows[2] == ""
    assert pii.redact(odd).columns == odd.columns and pii.redact(empty).count() == 0 and pii.find_pii(empty).count() == 0
    assert pii.find_pii(odd).count() == odd.count()


def test_iban_before_a_word(spark):
    texts = ["IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "NO9386011117947 AND MORE", "ZZ89370400440532013000"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("key").collect()
    assert [[(s.start, s.end) for s in r.iban] for r in rows] == [[(5, 27)], [(0, 27)], [(0, 15)], []]
    assert pii.redact(spark.createDataFrame([(texts[0],)], "text string")).first().text == "IBAN <IBAN> BIC COBADEFFXXX"
