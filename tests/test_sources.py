import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
import zstandard

from lociframe.sources import readers, writers


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(
        "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\n"
        "1\t10\trs1\tA\tG\t.\tPASS\t.\tGT\t0/1\t1|1\t./.\n1\t20\t.\tC\tT,G\t.\tPASS\t.\tGT:DS\t0/0:0.2\t0/1:1.1\t1/2:.\n"
    )
    g = readers.read_genotypes(spark, str(tmp_path / "x.vcf"))
    assert [tuple(r)[1:] for r in g.variants.orderBy("pos").collect()] == [("rs1", "1", 10, "G", "A"), ("1:20", "1", 20, "T", "C")]
    got = {(r.snp, r.iid): r.dosage for r in g.calls.join(g.variants, "v_idx").collect()}
    assert got == {("rs1", "A"): 1, ("rs1", "B"): 2, ("rs1", "C"): None, ("1:20", "A"): 0.2, ("1:20", "B"): 1.1, ("1:20", "C"): 2}
    lines = writers.vcf_lines(g.variants, g.calls, ["A", "B", "C"]).orderBy("pos").collect()
    assert lines[0].value.split("\t")[9:] == ["0/1", "1/1", "./."]
    haps = readers.read_haplotypes(spark, str(tmp_path / "x.vcf")).where("iid = 'B'").orderBy("v_idx", "copy").collect()
    assert [h.allele for h in haps][:2] == [1, 1]


def test_hapmap(spark, tmp_path):
    head = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\tA\tB\tC\tD\tE\n"
    (tmp_path / "x.hmp.txt").write_text(head + "s1\tA/G\t1\t10\t+\tNA\tNA\tNA\tNA\tNA\tNA\tAA\tAG\tGG\tNN\tR\n")
    g = readers.read_genotypes(spark, str(tmp_path / "x.hmp.txt"))
    assert {r.iid: r.dosage for r in g.calls.collect()} == {"A": 0, "B": 1, "C": 2, "D": None, "E": 1}
    assert g.variants.first().a1 == "G"


def test_plink(spark, tmp_path):
    rng = np.random.default_rng(0)
    calls = rng.choice([0, 1, 2, np.nan], (7, 5))
    codes = {2.0: 0, 1.0: 2, 0.0: 3}
    data = b"\x6c\x1b\x01"
    for row in calls:
        bits = [1 if np.isnan(x) else codes[x] for x in row] + [0] * 3
        data += bytes(sum(bits[4 * k + j] << (2 * j) for j in range(4)) for k in range(2))
    (tmp_path / "x.bed").write_bytes(data)
    (tmp_path / "x.fam").write_text("".join(f"F{k} I{k} 0 0 0 -9\n" for k in range(5)))
    (tmp_path / "x.bim").write_text("".join(f"1\trs{k}\t0\t{k * 10}\tA\tG\n" for k in range(7)))
    for size in (2, 1024):
        g = readers.read_plink(spark, str(tmp_path / "x"), range_bytes=size)
        got = {(r.v_idx, r.iid): r.dosage for r in g.calls.collect()}
        assert got == {(v, f"I{s}"): None if np.isnan(calls[v, s]) else calls[v, s] for v in range(7) for s in range(5)}
    assert readers.detect_format(str(tmp_path / "x.bed")) == "bed"


def test_tables(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",A,B\nm1,0,1.5\nm2,NA,2\n")
    g = readers.read_genotypes(spark, str(tmp_path / "d.csv"))
    assert sorted((r.iid, r.dosage) for r in g.calls.where("dosage IS NOT NULL").collect()) == [("A", 0), ("B", 1.5), ("B", 2)]
    (tmp_path / "r.bed").write_text("#c\n1\t10\t20\tx\n1\t5\tbad\n2\t0\t7\n")
    assert sorted(tuple(r) for r in readers.read_regions(spark, str(tmp_path / "r.bed")).collect()) == [("2:0-7", "2", 0, 7), ("x", "1", 10, 20)]
    (tmp_path / "s.tsv").write_text("SNP\tCHR\tBP\tA1\tA2\tOR\tSE\tP\nrs1\tchr1\t5\ta\tg\t1.0\t0.1\t0.5\n")
    row = readers.read_sumstats(spark, str(tmp_path / "s.tsv")).first()
    assert (row.chr, row.pos, row.a1, row.beta, row.n) == ("1", 5, "A", 0.0, None)
    (tmp_path / "p.txt").write_text("IID\tY1\tY2\ni1\t1\tNA\ni2\tNA\tNA\n")
    assert [tuple(r) for r in readers.read_phenotypes(spark, str(tmp_path / "p.txt")).collect()] == [("i1", 1.0, None)]
    with sqlite3.connect(tmp_path / "w.db") as con:
        con.execute("CREATE TABLE weights (gene, rsid, weight, ref_allele, eff_allele)")
        con.execute("INSERT INTO weights VALUES ('g', 'rs1', 0.5, 'A', 'G'), ('h', 'rs2', 0.01, 'A', 'G')")
    assert [r.gene for r in readers.read_weight_database(spark, str(tmp_path / "w.db"), least=0.1).collect()] == ["g"]


def bgen(path, dosages, layout=2, compression=1, phased=False, bits=8, names=True):
    """A BGEN file of certain calls (variants x samples, NaN missing)."""
    m, n = dosages.shape
    ids = [f"s{k}" for k in range(n)]
    block = struct.pack("<II", 8 + sum(2 + len(i) for i in ids), n) + b"".join(struct.pack("<H", len(i)) + i.encode() for i in ids) if names else b""
    flags = compression | layout << 2 | (1 << 31 if names else 0)
    out = struct.pack("<IIIII", 20 + len(block), 20, m, n, 0x6E656762) + struct.pack("<I", flags) + block
    text = lambda t: struct.pack("<H", len(t)) + t.encode()
    for v in range(m):
        head = text(f"id{v}") + text(f"rs{v}") + text("2") + struct.pack("<I", 100 * v + 5)
        if layout == 2:
            out += head + struct.pack("<H", 2) + b"".join(struct.pack("<I", 1) + a for a in (b"A", b"G"))
            full = (1 << bits) - 1
            values = []
            for d in dosages[v]:
                d = 0 if np.isnan(d) else int(d)
                values += [full * (d < 2), full * (d < 1)] if phased else [full * (d == 0), full * (d == 1)]
            if bits in (8, 16):
                packed = np.array(values, f"<u{bits // 8}").tobytes()
            else:
                packed = np.packbits(np.array([[x >> k & 1 for k in range(bits)] for x in values]).ravel(), bitorder="little").tobytes()
            data = struct.pack("<IHBB", n, 2, 2, 2) + bytes(2 | (128 if np.isnan(d) else 0) for d in dosages[v]) + bytes([phased, bits]) + packed
            body = zlib.compress(data) if compression == 1 else zstandard.ZstdCompressor().compress(data) if compression == 2 else data
            out += struct.pack("<I", len(body) + (4 if compression else 0)) + (struct.pack("<I", len(data)) if compression else b"") + body
        else:
            out += struct.pack("<I", n) + head + b"".join(struct.pack("<I", 1) + a for a in (b"A", b"G"))
            p = np.zeros((n, 3), "<u2")
            for k, d in enumerate(dosages[v]):
                if not np.isnan(d):
                    p[k, int(d)] = 32768
            body = zlib.compress(p.tobytes())
            out += struct.pack("<I", len(body)) + body
    path.write_bytes(out)


def test_bgen(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = rng.choice([0, 1, 2, np.nan], (6, 5))
    for k, options in enumerate(({}, {"compression": 2, "phased": True}, {"compression": 0, "bits": 16}, {"bits": 3}, {"layout": 1}, {"names": False})):
        bgen(tmp_path / f"{k}.bgen", d, **options)
        g = readers.read_genotypes(spark, str(tmp_path / f"{k}.bgen"))
        stem = "s" if options.get("names", True) else "sample_"
        assert {(r.v_idx, r.iid): r.dosage for r in g.calls.collect()} == {(v, f"{stem}{s}"): None if np.isnan(d[v, s]) else d[v, s] for v in range(6) for s in range(5)}, options
        assert [tuple(r) for r in g.variants.orderBy("v_idx").limit(2).collect()] == [(0, "rs0", "2", 5, "G", "A"), (1, "rs1", "2", 105, "G", "A")]


def test_pgen(spark, tmp_path):
    rng = np.random.default_rng(2)
    d = rng.choice([0, 1, 2, 3], (7, 6))
    data = b"\x6c\x1b\x02" + struct.pack("<IIB", 7, 6, 0)
    for row in d:
        codes = [*row.tolist(), 0, 0]
        data += bytes(sum(int(codes[4 * k + j]) << (2 * j) for j in range(4)) for k in range(2))
    (tmp_path / "x.pgen").write_bytes(data)
    (tmp_path / "x.psam").write_text("#FID\tIID\tSEX\n" + "".join(f"f\ti{k}\t1\n" for k in range(6)))
    (tmp_path / "x.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{k}\trs{k}\tC\tT\n" for k in range(7)))
    for size in (2, 100):
        g = readers.read_pgen(spark, str(tmp_path / "x"), range_bytes=size)
        assert {(r.v_idx, r.iid): r.dosage for r in g.calls.collect()} == {(v, f"i{s}"): None if d[v, s] == 3 else float(d[v, s]) for v in range(7) for s in range(6)}
    assert readers.read_genotypes(spark, str(tmp_path / "x.pgen")).variants.where("a1 = 'T' AND a2 = 'C'").count() == 7


def test_zarr(spark, tmp_path):
    rng = np.random.default_rng(3)
    d = rng.choice([-1, 0, 1, 2], (7, 5)).astype("i1")
    for k, codec in enumerate((None, "zlib", "zstd")):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / ".zarray").write_text(json.dumps({"shape": [7, 5], "chunks": [3, 2], "dtype": "|i1", "compressor": {"id": codec} if codec else None, "order": "C", "filters": None, "zarr_format": 2}))
        for a in range(3):
            for b in range(3):
                chunk = np.zeros((3, 2), "i1")
                own = d[3 * a : 3 * a + 3, 2 * b : 2 * b + 2]
                chunk[: own.shape[0], : own.shape[1]] = own
                raw = chunk.tobytes()
                (folder / f"{a}.{b}").write_bytes(zlib.compress(raw) if codec == "zlib" else zstandard.ZstdCompressor().compress(raw) if codec == "zstd" else raw)
        g = readers.read_zarr(spark, str(folder), [f"i{s}" for s in range(5)])
        assert {(r.v_idx, r.iid): r.dosage for r in g.calls.collect()} == {(v, f"i{s}"): None if d[v, s] < 0 else float(d[v, s]) for v in range(7) for s in range(5)}
        assert g.variants.count() == 7 and readers.detect_format(str(folder)) == "zarr"


def test_writers(spark, tmp_path):
    rng = np.random.default_rng(4)
    d = rng.choice([0, 1, 2, np.nan], (5, 6))
    variants = spark.createDataFrame([(v, f"rs{v}", "1", 10 * v + 10, "A", "G") for v in range(5)], "v_idx long, snp string, chr string, pos long, a1 string, a2 string")
    calls = spark.createDataFrame([(v, f"i{s}", None if np.isnan(d[v, s]) else float(d[v, s])) for v in range(5) for s in range(6)], "v_idx long, iid string, dosage double")
    names = [f"i{s}" for s in range(6)]
    writers.write_plink(variants, calls, names, f"{tmp_path}/w")
    writers.join_plink(spark, f"{tmp_path}/w", f"{tmp_path}/x.bed")
    for end in ("bim", "fam"):
        (tmp_path / f"x.{end}").write_text("".join(p.read_text() for p in sorted((tmp_path / f"w.{end}").glob("part-*"))))
    g = readers.read_plink(spark, f"{tmp_path}/x")
    assert {(r.v_idx, r.iid): r.dosage for r in g.calls.collect()} == {(v, f"i{s}"): None if np.isnan(d[v, s]) else d[v, s] for v in range(5) for s in range(6)}
    writers.write_vcf(variants, calls, names, f"{tmp_path}/v")
    (tmp_path / "v.vcf").write_text("".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))))
    back = readers.read_genotypes(spark, str(tmp_path / "v.vcf"))
    assert {(r.snp, r.iid): r.dosage for r in back.calls.join(back.variants, "v_idx").collect()} == {(f"rs{v}", f"i{s}"): None if np.isnan(d[v, s]) else d[v, s] for v in range(5) for s in range(6)}
    blocks = spark.createDataFrame([("1", 0, 10, 30, 3)], "chr string, block long, start long, end long, n_variants long")
    writers.write_blocks_det(blocks, variants, f"{tmp_path}/b")
    (tmp_path / "b.det").write_text("".join(p.read_text() for p in (tmp_path / "b").glob("part-*")))
    row = writers.read_blocks_det(spark, str(tmp_path / "b.det")).first()
    assert (row.chr, row.start, row.end, row.n_variants, row.snps) == ("1", 10, 30, 3, ["rs0", "rs1", "rs2"])
    writers.write_blocks_summary(blocks, f"{tmp_path}/sum")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/sum").first().n_blocks == "1"


def test_maps_and_covariates(spark, tmp_path):
    (tmp_path / "a.map").write_text("Marker,Chr,Position,cM\nm1,1,100,0.5\nm2,2,200,1.5\n")
    (tmp_path / "b.map").write_text("1 m1 0.5 100\n2 m2 1.5 200\n")
    for name in ("a", "b"):
        assert sorted(tuple(r) for r in readers.read_map(spark, str(tmp_path / f"{name}.map")).collect()) == [("m1", "1", 100, 0.5), ("m2", "2", 200, 1.5)]
    (tmp_path / "a.csv").write_text(",A,B\nm1,0,1.5\nm2,NA,2\n")
    assert readers.find_map(str(tmp_path / "a.csv")) == str(tmp_path / "a.map") and readers.find_map(str(tmp_path / "z.csv")) is None
    g = readers.with_map(readers.read_genotypes(spark, str(tmp_path / "a.csv")), readers.read_map(spark, str(tmp_path / "a.map")))
    assert sorted((r.snp, r.chr, r.pos) for r in g.variants.collect()) == [("m1", "1", 100), ("m2", "2", 200)]
    (tmp_path / "c.tsv").write_text("IID\tage\tsite\ni1\t30\tx\ni2\t40\ty\ni3\tNA\tz\n")
    (tmp_path / "p.tsv").write_text("IID\tY\ni1\t1\ni2\t2\ni3\t3\n")
    rows = readers.read_phenotypes(spark, str(tmp_path / "p.tsv"), str(tmp_path / "c.tsv")).orderBy("iid")
    assert rows.columns == ["iid", "Y", "age", "site_y", "site_z"] and [tuple(r)[2:] for r in rows.collect()] == [(30, 0, 0), (40, 1, 0), (None, 0, 1)]
    for head in ("EA\tNEA\tLOG_OR\tNEFF\tFRQ\tRS_ID", "A1\tA2\tBETA\tN\tA1_FREQ\tSNP"):
        (tmp_path / "s.tsv").write_text(f"CHR\tPOS\tSE\tP\t{head}\n1\t5\t0.1\t0.5\ta\tg\t0.3\t100\t0.2\trs1\n")
        row = readers.read_sumstats(spark, str(tmp_path / "s.tsv")).first()
        assert (row.a1, row.a2, row.beta, row.n, row.af, row.snp) == ("A", "G", 0.3, 100.0, 0.2, "rs1")
    (tmp_path / "s.tsv").write_text("SNP\tP\nrs1\t0.5\n")
    with pytest.raises(ValueError, match="odds ratio"):
        readers.read_sumstats(spark, str(tmp_path / "s.tsv"))


def test_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = readers._numbered(spark.read.text(str(tmp_path / "big.txt")))
        assert rows.rdd.getNumPartitions() > 2 and all(r.value == f"line {r.v_idx}" for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
