"""Genotype, phenotype and annotation files as DataFrames.

Every genotype reader gives two tables: variants (v_idx, snp, chr, pos, a1, a2) and calls
(v_idx, s_idx or iid, dosage), where dosage counts a1 and a missing call is null.
"""

from __future__ import annotations

import gzip
import json
import math
import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_ranges

#: Two-base codes of one-letter heterozygous calls, and marks of a missing one.
IUPAC = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC"}
MISSING = ("N", "NN", "NA", "-", "--", ".", "")
#: Header names of each column of summary statistics.
SUMSTATS = {
    "chr": ("chr", "chrom", "chromosome", "#chrom"), "pos": ("pos", "bp", "position", "base_pair_location"), "snp": ("snp", "rsid", "rs_id", "id", "markername", "variant_id"),
    "a1": ("a1", "effect_allele", "alt", "allele1", "ea"), "a2": ("a2", "other_allele", "ref", "allele2", "nea", "non_effect_allele"), "beta": ("beta", "b", "effect", "log_or", "log_odds"),
    "se": ("se", "stderr", "standard_error"), "p": ("p", "pval", "p_value", "pvalue", "p.value"), "n": ("n", "n_total", "samplesize", "neff", "n_eff"),
    "af": ("af", "eaf", "freq", "maf", "effect_allele_frequency", "frq", "a1_freq"), "or": ("or", "odds_ratio"),
}
#: Header names of a marker map.
MAP = {"snp": ("snp", "marker", "name", "id", "rsid"), "chr": ("chr", "chrom", "chromosome"), "pos": ("pos", "position", "bp"), "cm": ("cm", "genetic_position", "genetic")}


@dataclass(frozen=True)
class Genotypes:
    variants: DataFrame
    calls: DataFrame


def detect_format(path: str) -> str:
    """Name of a genotype file's format, from its first bytes, its header or its ending."""
    if Path(path).is_dir():
        for inner, name in ((".zarray", "zarr"), ("calls", "parquet")):
            if (Path(path) / inner).exists():
                return name
    with byte_ranges.open_input(path) as f:
        head = f.read(4096)
    if head[:2] == b"\x6c\x1b":
        return "bed" if head[2] == 1 else "pgen"
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 4096)
    if head[16:20] in (b"bgen", bytes(4)) and path.endswith(".bgen"):
        return "bgen"
    if head.startswith(b"##fileformat=VCF") or head.startswith(b"#CHROM"):
        return "vcf"
    if head.startswith(b"rs#"):
        return "hapmap"
    for ending, name in ((".bed", "bed"), (".vcf", "vcf"), (".hmp.txt", "hapmap"), (".parquet", "parquet"), (".csv", "dosage"), (".tsv", "dosage"), (".txt", "dosage")):
        if path.removesuffix(".gz").endswith(ending):
            return name
    raise ValueError(f"unknown genotype format: {path}")


def _numbered(lines: DataFrame) -> DataFrame:
    """Rows with v_idx, from 0 in file order and without gaps.

    Text files are read in order within and across splits, so a row's place is its place in its
    split after the rows of the splits before; only the splits' counts meet in one window.
    """
    rows = lines.withColumn("__id", F.monotonically_increasing_id())
    split = F.shiftright("__id", 33)
    counts = rows.groupBy(split.alias("__split")).count()
    earlier = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counts = counts.select("__split", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    placed = rows.withColumn("__of", split).join(F.broadcast(counts), F.col("__of") == F.col("__split"))
    return placed.withColumn("v_idx", (F.col("__before") + F.col("__id") - F.shiftleft("__of", 33)).cast("long")).drop("__id", "__of", "__split", "__before")


def read_vcf(spark: SparkSession, path: str, field: str = "auto") -> Genotypes:
    """Calls from DS where the record has it (or field is DS), else the alternate alleles of GT; a1 is the first ALT."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()["value"].split("\t")
    ids = header[9:]
    f = F.split("value", "\t")
    rows = _numbered(lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))).select("v_idx", f.alias("f"))
    at = lambda k: F.get("f", k)
    snp = F.when(at(2).isin(".", ""), F.concat_ws(":", at(0), at(1))).otherwise(at(2))
    variants = rows.select("v_idx", snp.alias("snp"), at(0).alias("chr"), at(1).cast("long").alias("pos"), F.get(F.split(at(4), ","), 0).alias("a1"), at(3).alias("a2"))
    keys = F.split(at(8), ":")
    cells = rows.select("v_idx", keys.alias("keys"), F.posexplode(F.slice("f", 10, len(ids))).alias("s", "cell"))
    parts = F.split("cell", ":")
    place = lambda name: F.array_position("keys", name).cast("int")
    value = lambda name: F.when(place(name) > 0, F.get(parts, place(name) - 1))
    alleles = F.split(value("GT"), r"[/|]")
    bad = F.exists(alleles, lambda a: ~a.rlike("^[0-9]+$"))
    gt = F.when(~bad, F.aggregate(alleles, F.lit(0.0), lambda n, a: n + F.when(a == "0", 0.0).otherwise(1.0)))
    ds = value("DS").try_cast("double")
    dosage = {"auto": F.coalesce(ds, gt), "DS": ds, "GT": gt}[field]
    names = F.array(*map(F.lit, ids))
    return Genotypes(variants, cells.select("v_idx", F.get(names, F.col("s")).alias("iid"), dosage.alias("dosage")))


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """(v_idx, iid, copy, allele) of the phased calls of a VCF file."""
    lines = spark.read.text(path)
    ids = lines.where(F.col("value").startswith("#CHROM")).first()["value"].split("\t")[9:]
    rows = _numbered(lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))).select("v_idx", F.posexplode(F.slice(F.split("value", "\t"), 10, len(ids))).alias("s", "cell"))
    alleles = F.split(F.get(F.split("cell", ":"), 0), r"\|")
    rows = rows.select("v_idx", F.get(F.array(*map(F.lit, ids)), F.col("s")).alias("iid"), F.posexplode(alleles).alias("copy", "allele"))
    return rows.withColumn("allele", F.col("allele").try_cast("int"))


def read_hapmap(spark: SparkSession, path: str) -> Genotypes:
    """HapMap table: two-letter, one-letter or numeric calls, counted for the second allele, which becomes a1."""
    table = _numbered(spark.read.option("sep", "\t").option("header", True).csv(path))
    ids = table.columns[11:-1]
    both = F.split("alleles", "/")
    variants = table.select("v_idx", F.col("rs#").alias("snp"), F.col("chrom").alias("chr"), F.col("pos").cast("long").alias("pos"), F.get(both, 1).alias("a1"), F.get(both, 0).alias("a2"))
    cells = table.select("v_idx", F.get(both, 1).alias("a1"), F.explode(F.array(*(F.struct(F.lit(i).alias("iid"), F.upper(F.trim(F.col(f"`{i}`"))).alias("c")) for i in ids))).alias("x")).select("v_idx", "a1", "x.*")
    pair = F.col("c")
    for code, letters in IUPAC.items():
        pair = F.when(F.col("c") == code, letters).otherwise(pair)
    pair = F.when(F.length(pair) == 1, F.concat(pair, pair)).otherwise(pair)
    counted = F.length(pair) - F.length(F.regexp_replace(pair, F.col("a1"), F.lit("")))
    dosage = F.when(F.coalesce(F.col("c").isin(*MISSING), F.lit(True)), None).when(F.col("c").rlike("^[0-9]+$"), F.col("c").try_cast("double")).otherwise(counted.cast("double"))
    return Genotypes(variants, cells.select("v_idx", "iid", dosage.alias("dosage")))


def read_dosage_table(spark: SparkSession, path: str, sep: str = ",") -> Genotypes:
    """Markers as rows: a first column of names, or chr, pos[, a1, a2] columns, then one column per sample."""
    table = _numbered(spark.read.option("sep", sep).option("header", True).csv(path))
    names = {c.lower(): c for c in table.columns}
    meta = [c for c in table.columns[:-1] if c.lower() in ("snp", "chr", "chrom", "pos", "bp", "a1", "a2")] or [table.columns[0]]
    ids = [c for c in table.columns[:-1] if c not in meta]
    pick = lambda *aliases: next((F.col(f"`{names[a]}`") for a in aliases if a in names), F.lit(None).cast("string"))
    snp = pick("snp") if "snp" in names else F.concat_ws(":", pick("chr", "chrom"), pick("pos", "bp")) if "pos" in names or "bp" in names else F.col(f"`{meta[0]}`")
    variants = table.select("v_idx", snp.alias("snp"), pick("chr", "chrom").alias("chr"), pick("pos", "bp").cast("long").alias("pos"), pick("a1").alias("a1"), pick("a2").alias("a2"))
    calls = table.select("v_idx", F.explode(F.array(*(F.struct(F.lit(i).alias("iid"), F.col(f"`{i}`").try_cast("double").alias("dosage")) for i in ids))).alias("x"))
    return Genotypes(variants, calls.select("v_idx", "x.iid", "x.dosage"))


def read_plink(spark: SparkSession, prefix: str, between: tuple[int, int] | None = None, range_bytes: int | None = None) -> Genotypes:
    """PLINK 1 binary set, variant-major, in byte ranges; ``between`` reads the calls of some variants only."""
    white = r"\s+"
    fam = spark.read.text(f"{prefix}.fam").where(F.length(F.trim("value")) > 0)
    ids = [r["iid"] for r in _numbered(fam).select("v_idx", F.get(F.split(F.trim("value"), white), 1).alias("iid")).orderBy("v_idx").collect()]
    rows = _numbered(spark.read.text(f"{prefix}.bim").where(F.length(F.trim("value")) > 0)).select("v_idx", F.split(F.trim("value"), white).alias("f"))
    at = lambda k: F.get("f", k)
    variants = rows.select("v_idx", at(1).alias("snp"), at(0).alias("chr"), at(3).cast("long").alias("pos"), at(4).alias("a1"), at(5).alias("a2"))
    return Genotypes(variants, _long(byte_ranges.read(spark, f"{prefix}.bed", "bed", len(ids), between=between, range_bytes=range_bytes), ids))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED regions (region, chr, start, end), half-open; lines that do not parse are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    f = F.split("value", r"\s+")
    start, end = F.get(f, 1).try_cast("long"), F.get(f, 2).try_cast("long")
    named = F.coalesce(F.get(f, 3), F.concat(F.get(f, 0), F.lit(":"), F.get(f, 1), F.lit("-"), F.get(f, 2)))
    return rows.select(named.alias("region"), F.get(f, 0).alias("chr"), start.alias("start"), end.alias("end")).where("start IS NOT NULL AND end > start")


def read_sumstats(spark: SparkSession, path: str, sep: str = "\t", columns: dict[str, str] | None = None) -> DataFrame:
    """Summary statistics under any of the usual headers; odds ratios become log odds."""
    table = spark.read.option("sep", sep).option("header", True).csv(path)
    have = {c.lower(): c for c in table.columns}
    found = {k: next((have[a] for a in aliases if a in have), None) for k, aliases in SUMSTATS.items()} | (columns or {})

    def number(k: str, kind: str) -> Column:
        return F.col(f"`{found[k]}`").try_cast(kind) if found[k] else F.lit(None).cast(kind)

    if not found["beta"] and not found["or"]:
        raise ValueError(f"{path} has neither an effect nor an odds ratio")
    beta = number("beta", "double") if found["beta"] else F.log(number("or", "double"))
    text = lambda k: F.col(f"`{found[k]}`") if found[k] else F.lit(None).cast("string")
    return table.select(
        F.regexp_replace(text("chr"), "^chr", "").alias("chr"), number("pos", "long").alias("pos"), text("snp").alias("snp"), F.upper(text("a1")).alias("a1"), F.upper(text("a2")).alias("a2"),
        beta.alias("beta"), number("se", "double").alias("se"), number("p", "double").alias("p"), number("n", "double").alias("n"), number("af", "double").alias("af"),
    )


def read_phenotypes(spark: SparkSession, path: str, covariates: str | None = None, sep: str = "\t", key: str = "IID") -> DataFrame:
    """Traits (and covariates) by sample: numbers where they parse, null for NA; rows without any trait are dropped."""
    traits = spark.read.option("sep", sep).option("header", True).csv(path)
    names = [c for c in traits.columns if c != key]
    rows = traits.select(F.col(key).alias("iid"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in names)).where(F.coalesce(*(F.col(f"`{c}`") for c in names)).isNotNull())
    if covariates:
        rows = rows.join(design(spark.read.option("sep", sep).option("header", True).csv(covariates), key), "iid")
    return rows


def design(table: DataFrame, key: str = "IID", most_levels: int = 100) -> DataFrame:
    """Covariates by sample: numbers as they are, words as one indicator for each level but the first in order."""
    names = [c for c in table.columns if c != key]
    told = table.agg(*(F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").isin("NA", "", "nan") & F.col(f"`{c}`").try_cast("double").isNull(), 1)).alias(f"w{k}") for k, c in enumerate(names))).first()
    columns = []
    for k, c in enumerate(names):
        if not told[f"w{k}"]:
            columns.append(F.col(f"`{c}`").try_cast("double").alias(c))
            continue
        levels = [r[0] for r in table.select(f"`{c}`").where(F.col(f"`{c}`").isNotNull()).distinct().orderBy(f"`{c}`").limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"covariate {c} has more than {most_levels} levels")
        columns += [(F.col(f"`{c}`") == v).cast("double").alias(f"{c}_{v}") for v in levels[1:]]
    return table.select(F.col(key).alias("iid"), *columns)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Marker map (snp, chr, pos, cm): columns by their header if there is one, else chr, snp[, cM], position; tabs, commas or blanks."""
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    f = F.split(F.trim("value"), r"[\s,]+")
    first = lines.select(f.alias("f")).first()
    names = [c.lower() for c in first["f"]] if first else []
    known = {k: next((names.index(a) for a in aliases if a in names), None) for k, aliases in MAP.items()}
    if known["snp"] is not None and known["pos"] is not None:
        body = lines.where(F.lower(F.get(f, 0)) != names[0])
        pick = lambda k: F.get(f, known[k]) if known[k] is not None else F.lit(None).cast("string")
        return body.select(pick("snp").alias("snp"), pick("chr").alias("chr"), pick("pos").try_cast("long").alias("pos"), pick("cm").try_cast("double").alias("cm"))
    return lines.select(F.get(f, 1).alias("snp"), F.get(f, 0).alias("chr"), F.element_at(f, -1).try_cast("long").alias("pos"), F.when(F.size(f) > 3, F.get(f, 2)).try_cast("double").alias("cm"))


def find_map(path: str) -> str | None:
    """A marker map beside a genotype file: the same name with .map, or a map file of its folder."""
    own = Path(path)
    stem = own.name.removesuffix(".gz").split(".")[0]
    for name in (f"{stem}.map", f"{stem}.map.txt", f"{stem}_map.txt", f"{stem}_map.csv", "map.txt", "map.csv"):
        if (own.parent / name).exists():
            return str(own.parent / name)
    return None


def with_map(g: Genotypes, table: DataFrame) -> Genotypes:
    """Places of the variants from a marker map, by name; those the map lacks keep their own."""
    own = table.select(F.col("snp").alias("__snp"), F.col("chr").alias("__chr"), F.col("pos").alias("__pos")).dropDuplicates(["__snp"])
    rows = g.variants.join(own, F.col("snp") == F.col("__snp"), "left")
    return Genotypes(rows.withColumns({"chr": F.coalesce("__chr", "chr"), "pos": F.coalesce("__pos", "pos")}).drop("__snp", "__chr", "__pos"), g.calls)


def _unpacked(packed: DataFrame, names: DataFrame | list[str]) -> Genotypes:
    """Variants and calls of rows (v_idx, snp, chr, pos, a1, a2, d) with one dosage for each of the names."""
    return Genotypes(packed.select("v_idx", "snp", "chr", "pos", "a1", "a2"), _long(packed, names))


def _long(packed: DataFrame, names: list[str]) -> DataFrame:
    """Calls (v_idx, iid, dosage) of rows (v_idx, d) with one dosage for each of the names."""
    ids = F.split(F.lit("\t".join(names)), "\t")
    return packed.select("v_idx", F.explode(F.arrays_zip(ids.alias("iid"), F.col("d").alias("dosage"))).alias("x")).select("v_idx", "x.iid", "x.dosage")


def _bits(data: bytes, width: int) -> np.ndarray:
    """Unsigned numbers of ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}").astype(np.int64)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    return flags[: len(flags) // width * width].reshape(-1, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def bgen_dosages(block: bytes, n: int, layout: int) -> np.ndarray:
    """Expected copies of the second allele from an uncompressed probability block."""
    if layout == 1:
        p = np.frombuffer(block, "<u2").reshape(n, 3) / 32768
        total = p.sum(axis=1)
        return np.where(total > 0, (p[:, 1] + 2 * p[:, 2]) / np.maximum(total, 1e-12), np.nan)
    size, alleles = struct.unpack_from("<IH", block)
    ploidy = np.frombuffer(block, np.uint8, size, 8)
    phased, width = block[8 + size], block[9 + size]
    if alleles != 2:
        raise ValueError("only variants of two alleles are read")
    missing, ploidy = ploidy & 128 > 0, (ploidy & 63).astype(int)
    p = _bits(block[10 + size :], width) / ((1 << width) - 1)
    first = np.concatenate(([0], np.cumsum(ploidy)))
    out = np.zeros(size)
    if phased:
        # a probability of the first allele for each haplotype
        np.add.at(out, np.repeat(np.arange(size), ploidy), 1 - p[: first[-1]])
    else:
        # a probability of 0 .. ploidy - 1 copies; the last class is the rest
        k = np.arange(first[-1]) - np.repeat(first[:-1], ploidy)
        rest = np.ones(size)
        np.subtract.at(rest, np.repeat(np.arange(size), ploidy), p[: first[-1]])
        np.add.at(out, np.repeat(np.arange(size), ploidy), k * p[: first[-1]])
        out += ploidy * rest
    return np.where(missing, np.nan, out)


def read_bgen(spark: SparkSession, path: str, samples: list[str] | None = None, between: tuple[int, int] | None = None, range_bytes: int | None = None) -> Genotypes:
    """BGEN 1.1 to 1.3, two alleles, in byte ranges; a1 is the second allele. Probabilities are unpacked for the calls only."""
    head, names = byte_ranges.bgen_header(path)
    read = lambda schema: byte_ranges.read(spark, path, "bgen", head.samples, schema, between, range_bytes)
    return Genotypes(read(byte_ranges.VARIANTS), _long(read(byte_ranges.CALLS), samples or names))


def zstandard():
    import zstandard as library

    return library.ZstdDecompressor()


def _small_file(spark: SparkSession, path: str) -> str:
    """Text of a small file in any store; Spark's own readers pass over names that begin with a dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_zarr(spark: SparkSession, path: str, samples: list[str], variants: DataFrame | None = None) -> Genotypes:
    """A Zarr 2 array of dosages (variants x samples), chunks raw or by zlib, gzip or zstd; -1 and NaN are missing.

    Chunks are files, read by Spark; a chunk is one row of one task.
    """
    told = json.loads(_small_file(spark, f"{path}/.zarray"))
    shape, chunk, kind = told["shape"], told["chunks"], np.dtype(told["dtype"])
    codec = (told.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip", "zstd") or told.get("filters"):
        raise ValueError(f"chunks by {codec} are not read")
    sep = told.get("dimension_separator", ".")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"/[0-9]+[./][0-9]+$"))
    place = F.split(F.regexp_extract("path", r"([0-9]+[./][0-9]+)$", 1), r"\." if sep == "." else "/")
    files = files.select(place[0].cast("long").alias("a"), place[1].cast("long").alias("b"), "content")

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "content")), strict=True):
                data = zlib.decompress(data) if codec == "zlib" else gzip.decompress(data) if codec == "gzip" else zstandard().decompress(data, 1 << 31) if codec == "zstd" else data
                d = np.frombuffer(data, kind).reshape(chunk, order=told.get("order", "C")).astype(float)[: shape[0] - a * chunk[0], : shape[1] - b * chunk[1]]
                v, s = np.divmod(np.arange(d.size), d.shape[1])
                d = np.where(d.ravel() < 0, np.nan, d.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(v + a * chunk[0]), pa.array(s + b * chunk[1]), pa.array(d, from_pandas=True)], ["v_idx", "s", "dosage"])

    ids = F.split(F.lit("\t".join(samples)), "\t")
    calls = files.mapInArrow(decode, "v_idx bigint, s bigint, dosage double").select("v_idx", F.get(ids, F.col("s").cast("int")).alias("iid"), "dosage")
    if variants is None:
        none = F.lit(None).cast("string")
        variants = spark.range(shape[0]).select(F.col("id").alias("v_idx"), F.concat(F.lit("v"), "id").alias("snp"), none.alias("chr"), F.lit(None).cast("long").alias("pos"), none.alias("a1"), none.alias("a2"))
    return Genotypes(variants, calls)


def read_pgen(spark: SparkSession, prefix: str, between: tuple[int, int] | None = None, range_bytes: int | None = None, dosages: bool = False) -> Genotypes:
    """PLINK 2 calls of fixed or variable width in byte ranges, variants and samples from .pvar and .psam; a1 is the alternate allele.

    ``dosages`` takes those a record has before its calls.
    """
    psam = spark.read.text(f"{prefix}.psam").where(~F.col("value").startswith("##"))
    f = F.split(F.trim("value"), r"\s+")
    head = psam.where(F.col("value").startswith("#")).select(f.alias("f")).first()
    at_iid = [c.lstrip("#").upper() for c in head["f"]].index("IID") if head else 1
    ids = [r["iid"] for r in _numbered(psam.where(~F.col("value").startswith("#"))).select("v_idx", F.get(f, at_iid).alias("iid")).orderBy("v_idx").collect()]
    pvar = _numbered(spark.read.text(f"{prefix}.pvar").where(~F.col("value").startswith("#") & (F.length("value") > 0))).select("v_idx", f.alias("f"))
    at = lambda k: F.get("f", k)
    variants = pvar.select("v_idx", at(2).alias("snp"), at(0).alias("chr"), at(1).cast("long").alias("pos"), at(4).alias("a1"), at(3).alias("a2"))
    return Genotypes(variants, _long(byte_ranges.read(spark, f"{prefix}.pgen", "pgen", len(ids), between=between, range_bytes=range_bytes, dosages=dosages), ids))


def set_weights(af: Column, a: float = 1.0, b: float = 25.0) -> Column:
    """Weights of variants in set tests: the squared beta density at the minor allele's frequency."""
    maf = F.least(af, 1 - af)
    constant = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.pow(constant * F.pow(maf, a - 1) * F.pow(1 - maf, b - 1), 2)


def database_genes(path: str) -> list[str]:
    """Genes of a prediction database."""
    with sqlite3.connect(path) as con:
        return [r[0] for r in con.execute("SELECT DISTINCT gene FROM weights ORDER BY gene")]


def read_weight_database(spark: SparkSession, path: str, genes: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(gene, rsid, weight, ref_allele, eff_allele) of a prediction database; the file is small and read on the driver."""
    with sqlite3.connect(path) as con:
        rows = con.execute("SELECT gene, rsid, weight, ref_allele, eff_allele FROM weights").fetchall()
    frame = spark.createDataFrame(rows, "gene string, rsid string, weight double, ref_allele string, eff_allele string").where(F.abs("weight") >= least)
    return frame.where(F.col("gene").isin(genes)) if genes else frame


def read_genotypes(spark: SparkSession, path: str, fmt: str | None = None) -> Genotypes:
    """Any supported genotype file."""
    fmt = fmt or detect_format(path)
    if fmt == "vcf":
        return read_vcf(spark, path)
    if fmt == "hapmap":
        return read_hapmap(spark, path)
    if fmt == "bed":
        return read_plink(spark, path.removesuffix(".bed"))
    if fmt == "bgen":
        return read_bgen(spark, path)
    if fmt == "pgen":
        return read_pgen(spark, path.removesuffix(".pgen"))
    if fmt == "parquet":
        return Genotypes(spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/calls"))
    if fmt == "zarr":
        n = json.loads(_small_file(spark, f"{path}/.zarray"))["shape"][1]
        return read_zarr(spark, path, [f"sample_{k}" for k in range(n)])
    if fmt == "dosage":
        return read_dosage_table(spark, path, "," if path.endswith(".csv") else "\t")
    raise ValueError(f"no reader for {fmt}")
