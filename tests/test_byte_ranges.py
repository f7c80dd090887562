"""Binary genotype files by byte ranges: every way of a PLINK 2 record, many tasks a file, files above 2 GB."""

import os
import sqlite3
import struct

import numpy as np
import pytest
from test_sources import bgen

from lociframe.cli import call
from lociframe.sources import byte_ranges, pgen, readers


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def pack(codes, bits):
    per = 8 // bits
    codes = [*map(int, codes)] + [0] * (-len(codes) % per)
    return bytes(sum(codes[per * k + j] << (bits * j) for j in range(per)) for k in range(len(codes) // per))


def listed(samples, codes, n):
    if not len(samples):
        return b"\0"
    width = max(1, (n.bit_length() + 7) // 8)
    groups = [list(map(int, samples[k : k + 64])) for k in range(0, len(samples), 64)]
    deltas = [b"".join(varint(b - a) for a, b in zip(g, g[1:])) for g in groups]
    out = varint(len(samples)) + b"".join(g[0].to_bytes(width, "little") for g in groups) + bytes(len(d) - 63 for d in deltas[:-1])
    return out + (pack(codes, 2) if codes is not None else b"") + b"".join(deltas)


def record(codes, way, base=None, dosage=None, phase=None):
    """(type, bytes) of one record; dosage is (way, samples, values)."""
    n = len(codes)
    if way == 0:
        body = pack(codes, 2)
    elif way == 1:
        low, high = sorted(np.argsort(-np.bincount(codes, minlength=4), kind="stable")[:2])
        odd = np.flatnonzero((codes != low) & (codes != high))
        body = bytes([low * 4 + high - low]) + pack(codes == high, 1) + listed(odd, codes[odd], n)
    else:
        want = np.array([2, 1, 0, 3])[codes] if way == 3 else codes
        odd = np.flatnonzero(want != (base if way in (2, 3) else np.full(n, way & 3)))
        body = listed(odd, want[odd], n)
    kind = way
    if phase is not None:
        hets = int((codes == 1).sum())
        kind |= 16
        told = np.arange(hets) % 3 == 0 if phase else np.ones(hets, bool)
        body += pack([1, *told], 1) + pack(np.ones(told.sum(), int), 1) if phase else pack([0, *told], 1)
    if dosage is not None:
        mode, samples, values = dosage
        kind |= mode
        body += listed(samples, None, n) if mode == 0x20 else pack(np.isin(np.arange(n), samples), 1) if mode == 0x60 else b""
        body += np.asarray(values, "<u2").tobytes()
    return kind, body


def write(path, records, n, control):
    """A file of variable width; records (type, bytes)."""
    width, wide = 1 + (control & 3), control & 4
    blocks = [records[k : k + pgen.BLOCK] for k in range(0, len(records), pgen.BLOCK)]
    tables = []
    for b in blocks:
        kinds = bytes(k for k, _ in b) if wide else pack([k for k, _ in b], 4)
        tables.append(kinds + b"".join(len(r).to_bytes(width, "little") for _, r in b) + (bytes((len(b) + 7) // 8) if control >> 6 == 3 else b""))
    at = 12 + 8 * len(blocks) + sum(map(len, tables))
    places = []
    for b in blocks:
        places.append(at)
        at += sum(len(r) for _, r in b)
    head = b"\x6c\x1b\x10" + struct.pack("<IIB", len(records), n, control)
    path.write_bytes(head + struct.pack(f"<{len(blocks)}Q", *places) + b"".join(tables) + b"".join(r for b in blocks for _, r in b))


def sets(tmp_path, n, variants):
    (tmp_path / "x.psam").write_text("#IID\n" + "".join(f"i{k}\n" for k in range(n)))
    (tmp_path / "x.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{k}\trs{k}\tC\tT\n" for k in range(variants)))


def matrix(calls, variants, n):
    out = np.full((variants, n), -1.0)
    for r in calls.collect():
        out[r.v_idx, int(r.iid[1:])] = np.nan if r.dosage is None else r.dosage
    return out


@pytest.mark.parametrize("n,control,block", [(5, 1, 8), (300, 5, 1 << 16), (300, 0xC1, 16), (130, 6, 16), (70_000, 7, 16)])
def test_variable_width(spark, tmp_path, monkeypatch, n, control, block):
    """Every way of a record, lists of several groups, blocks and ranges that begin among references."""
    monkeypatch.setattr(pgen, "BLOCK", block)
    rng = np.random.default_rng(n)
    codes, records, base = [], [], None
    wide = control & 4
    for v in range(21):
        way = [0, 2, 3, 1, 2, 4, 2, 3, 6, 7][v % 10] if v % block else 1
        own = rng.choice(4, n, p=[0.6, 0.25, 0.1, 0.05]) if way in (0, 1) else np.full(n, way & 3) if way > 3 else base.copy()
        odd = rng.random(n) < 0.15
        own[odd] = rng.choice(4, odd.sum())
        own = np.array([2, 1, 0, 3])[own] if way == 3 else own
        codes.append(own)
        records.append(record(own, way, base, phase=[None, True, False][v % 3] if wide else None))
        if way not in (2, 3):
            base = own
    write(tmp_path / "x.pgen", records, n, control)
    if block != 1 << 16:  # workers have blocks of the published size, so without Spark
        with byte_ranges.open_input(str(tmp_path / "x.pgen")) as f:
            head = pgen.header(f)
            for first, count in ((0, min(block, 16)), (7, 1), (16, 5)):
                got = np.stack(list(pgen.records(f, head, first, count)))
                assert np.array_equal(got, pgen.COPIES[np.stack(codes[first : first + count])], equal_nan=True)
        return
    sets(tmp_path, n, 21)
    for size in (40, 1 << 20):
        got = matrix(readers.read_pgen(spark, str(tmp_path / "x"), range_bytes=size).calls, 21, n)
        assert np.array_equal(got, pgen.COPIES[np.stack(codes)], equal_nan=True)
    some = readers.read_pgen(spark, str(tmp_path / "x"), between=(6, 9)).calls
    assert sorted({r.v_idx for r in some.collect()}) == [6, 7, 8, 9]


def test_pgen_dosages(spark, tmp_path):
    n, rng = 200, np.random.default_rng(3)
    codes = rng.choice(3, (6, n))
    want, records = [], []
    for v, (mode, phase) in enumerate([(0x20, None), (0x40, None), (0x60, None), (0x20, True), (0x60, False), (None, None)]):
        samples = np.arange(n) if mode == 0x40 else np.flatnonzero(rng.random(n) < 0.5)
        values = rng.integers(0, 32769, len(samples))
        values[0] = 65535 if mode == 0x40 else values[0]
        own = codes[v].astype(float)
        if mode:
            known = values != 65535
            own[samples[known]] = values[known] / 16384
        want.append(own)
        records.append(record(codes[v], 0, dosage=(mode, samples, values) if mode else None, phase=phase))
    write(tmp_path / "x.pgen", records, n, 5)
    sets(tmp_path, n, 6)
    assert np.array_equal(matrix(readers.read_pgen(spark, str(tmp_path / "x"), dosages=True).calls, 6, n), np.stack(want))
    assert np.array_equal(matrix(readers.read_pgen(spark, str(tmp_path / "x")).calls, 6, n), codes)


def test_broken_pgen(tmp_path):
    path = tmp_path / "x.pgen"
    for kind, body, told in ((2, b"\0", "refers"), (5, b"\0", "not defined"), (4, varint(2) + b"\x09\x00\x01", "beyond|early"), (0, b"", "early")):
        write(path, [(kind, body)], 9, 5)
        with byte_ranges.open_input(str(path)) as f, pytest.raises(ValueError, match=told):
            list(pgen.records(f, pgen.header(f), 0, 1))


def test_tasks(spark, tmp_path):
    """A file is as many tasks as it has ranges; only some variants are planned where only they are wanted."""
    rng = np.random.default_rng(0)
    bgen(tmp_path / "x.bgen", rng.choice([0, 1, 2], (40, 30)))
    whole = readers.read_bgen(spark, str(tmp_path / "x.bgen"))
    small = readers.read_bgen(spark, str(tmp_path / "x.bgen"), range_bytes=300)
    assert whole.calls.rdd.getNumPartitions() == 1 and small.calls.rdd.getNumPartitions() > 5
    key = lambda r: (r.v_idx, r.iid)
    assert sorted(whole.calls.collect(), key=key) == sorted(small.calls.collect(), key=key)
    assert sorted(whole.variants.collect()) == sorted(small.variants.collect())
    some = readers.read_bgen(spark, str(tmp_path / "x.bgen"), range_bytes=300, between=(10, 12))
    assert some.calls.rdd.getNumPartitions() < 4
    assert sorted({r.v_idx for r in some.variants.collect()}) == [10, 11, 12] and some.calls.count() == 90
    # an index beside the file gives the same ranges without reading the headers
    head, _ = byte_ranges.bgen_header(str(tmp_path / "x.bgen"))
    ranges = byte_ranges.BgenReader({"path": str(tmp_path / "x.bgen"), "range_bytes": "1"}, ["v_idx"]).partitions()
    with sqlite3.connect(tmp_path / "x.bgen.bgi") as con:
        con.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
        con.executemany("INSERT INTO Variant VALUES ('1', 1, 'x', 2, 'A', 'G', ?, ?)", [(r.start, r.end - r.start) for r in ranges])
    assert len(ranges) == 40 and sorted(readers.read_bgen(spark, str(tmp_path / "x.bgen"), range_bytes=300).calls.collect(), key=key) == sorted(whole.calls.collect(), key=key)


def test_bed_above_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.5 GB: the calls of its last variants."""
    n, stride = 100_000_000, 25
    path = tmp_path / "x.bed"
    with open(path, "wb") as f:
        f.write(b"\x6c\x1b\x01")
        f.seek(3 + (n - 2) * stride)
        f.write(bytes([0b11111111]) * stride + bytes([0b01101100]) * stride)
    assert os.path.getsize(path) == 3 + n * stride
    assert byte_ranges.read(spark, str(path), "bed", 100).rdd.getNumPartitions() == -(-n // (byte_ranges.RANGE_BYTES // stride))
    rows = sorted(byte_ranges.read(spark, str(path), "bed", 100, between=(n - 3, n)).collect())
    assert [r.v_idx for r in rows] == [n - 3, n - 2, n - 1]
    assert rows[0].d == [2.0] * 100 and rows[1].d == [0.0] * 100 and rows[2].d == [2.0, 0.0, 1.0, None] * 25
    path.write_bytes(b"\x6c\x1b\x01" + bytes(7))
    with pytest.raises(Exception, match="whole rows"):
        byte_ranges.read(spark, str(path), "bed", 100).count()


def test_parquet_and_zarr_are_read_by_name(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",A,B\nm1,0,1\nm2,NA,2\n")
    call(spark, "convert", genotypes=f"{tmp_path}/d.csv", to="parquet", out=f"{tmp_path}/p")
    assert readers.detect_format(f"{tmp_path}/p") == "parquet"
    calls = readers.read_genotypes(spark, f"{tmp_path}/p").calls
    assert {(r.v_idx, r.iid): r.dosage for r in calls.collect()} == {(0, "A"): 0, (0, "B"): 1, (1, "A"): None, (1, "B"): 2}
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / ".zarray").write_text('{"shape": [2, 3], "chunks": [2, 3], "dtype": "|i1", "compressor": null, "filters": null, "order": "C", "zarr_format": 2}')
    (tmp_path / "z" / "0.0").write_bytes(bytes([0, 1, 2, 255, 0, 1]))
    got = readers.read_genotypes(spark, f"{tmp_path}/z").calls
    assert {(r.v_idx, r.iid): r.dosage for r in got.collect()} == {(0, "sample_0"): 0, (0, "sample_1"): 1, (0, "sample_2"): 2, (1, "sample_0"): None, (1, "sample_1"): 0, (1, "sample_2"): 1}
