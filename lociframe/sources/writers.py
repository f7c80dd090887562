"""Result files: association tables, blocks, manifests, QC, VCF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_association(scan: DataFrame, path: str) -> None:
    """Tab-separated table with upper-case headers, in genome order."""
    names = ["chr", "pos", "snp", "a1", "a2", "af", "beta", "se", "stat", "p", "p_adj"]
    rows = scan.select(*(F.col(c).alias(c.upper()) for c in names if c in scan.columns))
    rows.repartitionByRange("CHR", "POS").sortWithinPartitions("CHR", "POS").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_blocks_bed(blocks: DataFrame, path: str) -> None:
    """BED lines chr, start - 1, end, block."""
    blocks.select("chr", (F.col("start") - 1).alias("start"), "end", "block").write.mode("overwrite").option("sep", "\t").csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_qc(stats: DataFrame, path: str) -> None:
    stats.select(*(F.col(c).alias(c.upper()) for c in stats.columns)).write.mode("overwrite").parquet(path)


def vcf_lines(variants: DataFrame, calls: DataFrame, samples: list[str]) -> DataFrame:
    """One VCF body line per variant (value, chr, pos), diploid calls in the given sample order."""
    code = F.when(F.col("dosage").isNull(), "./.").when(F.round("dosage") == 0, "0/0").when(F.round("dosage") == 1, "0/1").otherwise("1/1")
    own = calls.groupBy("v_idx").agg(F.map_from_entries(F.collect_list(F.struct("iid", code))).alias("calls"))
    cells = F.transform(F.array(*map(F.lit, samples)), lambda s: F.coalesce(F.element_at("calls", s), F.lit("./.")))
    rows = variants.join(own, "v_idx")
    head = F.concat_ws("\t", "chr", F.col("pos").cast("string"), "snp", "a2", "a1", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"))
    return rows.select(F.concat_ws("\t", head, F.array_join(cells, "\t")).alias("value"), "chr", "pos")


def write_vcf(variants: DataFrame, calls: DataFrame, samples: list[str], path: str) -> None:
    """A folder of VCF parts in genome order, the first with the header's lines."""
    spark = variants.sparkSession
    header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    top = spark.createDataFrame([(line, "", -1, k) for k, line in enumerate(header)], "value string, chr string, pos long, k int")
    rows = vcf_lines(variants, calls, samples).withColumn("k", F.lit(len(header)))
    top.unionByName(rows).repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos", "k").select("value").write.mode("overwrite").text(path)


def plink_rows(variants: DataFrame, calls: DataFrame, samples: list[str]) -> DataFrame:
    """(v_idx, data): the two-bit calls of each variant in the given sample order, as in a variant-major PLINK file."""
    code = F.when(F.col("dosage").isNull(), 1).when(F.round("dosage") >= 2, 0).when(F.round("dosage") == 1, 2).otherwise(3)
    own = calls.groupBy("v_idx").agg(F.map_from_entries(F.collect_list(F.struct("iid", code))).alias("calls"))
    cells = F.transform(F.array(*map(F.lit, samples)), lambda s: F.coalesce(F.element_at("calls", s), F.lit(1)))
    bytes_ = F.transform(
        F.sequence(F.lit(0), F.lit((len(samples) + 3) // 4 - 1)),
        lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda a, j: a + F.coalesce(F.get("cells", k * 4 + j), F.lit(0)) * F.pow(F.lit(4), j).cast("int")),
    )
    rows = variants.select("v_idx").join(own, "v_idx").withColumn("cells", cells)
    return rows.select("v_idx", F.unhex(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("data"))


def write_plink(variants: DataFrame, calls: DataFrame, samples: list[str], prefix: str) -> None:
    """PREFIX.bim and .fam as folders of text, and PREFIX.bed as Parquet rows of a variant's bytes in order; `join_plink` makes the one file that other tools read."""
    spark = variants.sparkSession
    bim = variants.select("v_idx", F.concat_ws("\t", "chr", "snp", F.lit("0"), F.col("pos").cast("string"), "a1", "a2").alias("value"))
    bim.repartitionByRange("v_idx").sortWithinPartitions("v_idx").select("value").write.mode("overwrite").text(f"{prefix}.bim")
    spark.createDataFrame([(f"{i} {i} 0 0 0 -9",) for i in samples], "value string").coalesce(1).write.mode("overwrite").text(f"{prefix}.fam")
    plink_rows(variants, calls, samples).repartitionByRange("v_idx").sortWithinPartitions("v_idx").write.mode("overwrite").parquet(f"{prefix}.bed")


def join_plink(spark, prefix: str, target: str) -> None:
    """One .bed file from the rows that `write_plink` left, streamed through the driver variant by variant."""
    with open(target, "wb") as f:
        f.write(b"\x6c\x1b\x01")
        for r in spark.read.parquet(f"{prefix}.bed").orderBy("v_idx").toLocalIterator():
            f.write(r["data"])


def blocks_det(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(CHR, BP1, BP2, KB, NSNPS, SNPS) of block sets; members: (chr, pos, snp)."""
    hit = blocks.select("chr", "block", "start", "end").join(members.select(F.col("chr").alias("__c"), "pos", "snp"), (F.col("chr") == F.col("__c")) & F.col("pos").between(F.col("start"), F.col("end")))
    rows = hit.groupBy("chr", "block", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", "snp"))).alias("m"))
    return rows.select(
        F.col("chr").alias("CHR"), F.col("start").alias("BP1"), F.col("end").alias("BP2"), F.round((F.col("end") - F.col("start") + 1) / 1000, 3).alias("KB"), F.size("m").alias("NSNPS"),
        F.array_join(F.transform("m", lambda x: x["snp"]), "|").alias("SNPS"),
    )


def write_blocks_det(blocks: DataFrame, members: DataFrame, path: str) -> None:
    blocks_det(blocks, members).repartitionByRange("CHR", "BP1").sortWithinPartitions("CHR", "BP1").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_blocks_det(spark, path: str) -> DataFrame:
    """Blocks (chr, block, start, end, n_variants, snps) of a .blocks.det file, columns by white space."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("CHR"))
    rows = rows.select(F.get(f, 0).alias("chr"), F.get(f, 1).cast("long").alias("start"), F.get(f, 2).cast("long").alias("end"), F.get(f, 4).cast("long").alias("n_variants"), F.split(F.get(f, 5), r"\|").alias("snps"))
    return rows.withColumn("block", F.concat_ws("-", F.get("snps", 0), F.element_at("snps", -1)))


def write_blocks_summary(blocks: DataFrame, path: str) -> None:
    from lociframe.operators.blocks import summary

    summary(blocks).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
