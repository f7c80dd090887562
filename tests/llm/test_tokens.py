import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import thue_morse
from tokenizers import Tokenizer

from lociframe.llm import packing, token_counts
from lociframe.llm.registry import op1_packing, op8_token_counts, tokenizer_file
from lociframe.llm.tokens import Encoder

HARD = [
    "", None, " ", "\n\n x", "a  b", "a  b", "a　 b   c", "it's 'll  <|endoftext|> x", "é é  é", "\U0001f600 \U0001f600", "x\t y",
    "a\n \n b", "tail  ", "\x1c a \x1f b", "한국어 텍 ", "a  b \u0085 c\u0085 d", "1234 5678", "x" * 5000, "don't they'll", "0 " * 3000,
    *(t for n in (1024, 2048, 4096, 65536) for t in thue_morse(n)),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def test_encoder(tokenizer):
    encoder, rng = Encoder(tokenizer_file()), random.Random(1)
    texts = HARD + ["".join(rng.choice("ab'sé  \n\t.1　ß-") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want  # from the cache


def test_plan():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        used, ranks = defaultdict(list), defaultdict(list)
        for r in packing.plan(counts, capacity):
            for t in range(r.items):
                used[r.first + t // r.each].append((r.offset + t % r.each * r.length, r.length))
                ranks[r.length].append(r.rank + t)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
        for own in used.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
        # best fit item by item gives as many sequences
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((r for r in rooms if r >= length), default=None)
                if fit is not None:
                    rooms.remove(fit)
                rooms.append((fit if fit is not None else capacity) - length)
        assert len(used) == len(rooms)


def check_packing(rows, docs, tokenizer):
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in docs.items()}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == docs.keys()
    for k, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(math.ceil(len(ids[k]) / 2048))) and sum(r.length for r in own) == len(ids[k])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 2048 or r.piece == 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.05 * math.ceil(total / 2048) + 1


def test_packing(spark, sf, tokenizer, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(op1_packing(spark, sf).collect(), docs, tokenizer)
    spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(op1_packing(spark, str(tmp_path)).collect(), dict(enumerate(HARD)), tokenizer)


def test_odd(spark, odd, empty):
    assert packing.pack(odd, tokenizer_file()).where("piece = 0").count() == odd.count()
    assert packing.pack(empty, tokenizer_file()).count() == 0
    assert sum(len(r.ids) for r in packing.sequences(odd, tokenizer_file()).collect()) == packing.pack(odd, tokenizer_file()).selectExpr("sum(length)").first()[0]
    assert token_counts.document_tokens(odd, tokenizer_file(), 50256).count() == odd.count()
    assert token_counts.document_tokens(empty, tokenizer_file(), 50256).count() == 0


def test_token_counts(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokenizer.encode_special_tokens = True
    rows = op8_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in docs.items()}


def test_separator_scan(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for f in range(3):
        ids = [rng.choice([7, 8, 9, 0]) if f else 5 for _ in range(1000)]
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        start = nth = 0
        for i, x in enumerate(ids):
            if x == 0:
                want.append((f, nth, start, i - start, True))
                nth, start = nth + 1, i + 1
        if start < len(ids):
            want.append((f, nth, start, len(ids) - start, False))
    for block in (1, 7, 1000, 5000):
        blocks = token_counts.read_token_files(spark, str(tmp_path), 2, block)
        got = [(int(r.file.rsplit("/", 1)[1][0]), r.nth, r.start, r.n_tokens, r.ended) for r in token_counts.count_tokens(blocks, 0).collect()]
        assert sorted(got) == sorted(want)


LONG = [" " * 2_000_000 + "x", "\n" * 2_000_000, "a \xa0" + "\xa0" * 2_000_000 + " b", "a " + "\n \t\u3000" * 300_000 + "word" + " " * 5000 + "\n" * 5000 + "z", "abcdefghij" * 500_000]


def test_long_runs(tokenizer):
    assert [x.tolist() for x in Encoder(tokenizer_file()).encode(LONG)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in LONG]


def test_packing_of_long_runs(spark, tmp_path, tokenizer):
    texts = dict(enumerate(["\n" * 1_010_000, "  " * 600_000, "short"]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(op1_packing(spark, str(tmp_path)).collect(), texts, tokenizer)
    rows = {r.doc_id: r.n_tokens for r in op8_token_counts(spark, str(tmp_path)).collect()}
    assert rows == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def test_id_width(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts.token_files(docs, tokenizer_file(), 70_000)
    monkeypatch.setattr(Encoder.of(tokenizer_file()), "largest", 70_000)
    assert token_counts.width_for(tokenizer_file(), 0) == 4
    assert token_counts.document_tokens(docs, tokenizer_file(), 50256).first().n_tokens == 2
