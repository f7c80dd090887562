"""Derived genomics views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: CTEs that every oracle may use; each is the SQL of the function of the same name.
SQL = {
    "geno": "SELECT l_partkey % 200 AS v_idx, l_suppkey AS s_idx, (min(floor(l_quantity)::INT) % 3)::DOUBLE AS dosage FROM lineitem GROUP BY 1, 2",
    "variants": """SELECT v_idx, 'rs' || v_idx AS snp, 'chr' || (v_idx % 5) AS chr, (v_idx // 5) * 1000 + 1 AS pos,
        substr('ACGT', (v_idx % 4 + 1)::INT, 1) AS a1, substr('CGTA', (v_idx % 4 + 1)::INT, 1) AS a2 FROM (SELECT DISTINCT l_partkey % 200 AS v_idx FROM lineitem)""",
    "samples": "SELECT s_suppkey AS s_idx, s_acctbal / 1000 AS y, s_nationkey AS family, (s_suppkey % 7)::DOUBLE AS cov, (s_acctbal > 5000)::INT AS status FROM supplier",
    "studies": """SELECT study, s.v_idx, snp, chr, pos, a1, a2, n, beta, se FROM (
        SELECT l_returnflag AS study, l_partkey % 200 AS v_idx, count(*) AS n, regr_slope(l_extendedprice / 1000, l_discount * 100) AS beta,
          sqrt((regr_syy(l_extendedprice / 1000, l_discount * 100) - regr_slope(l_extendedprice / 1000, l_discount * 100) * regr_sxy(l_extendedprice / 1000, l_discount * 100))
            / (count(*) - 2) / regr_sxx(l_extendedprice / 1000, l_discount * 100)) AS se
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 4 AND regr_sxx(l_extendedprice / 1000, l_discount * 100) > 0) s JOIN variants USING (v_idx)""",
    "pvals": "SELECT v_idx, snp, chr, pos, beta, se, n, exp(-power(beta / se, 2) / 2) AS p FROM studies WHERE study = 'N'",
    "genes": "SELECT p_brand AS gene, 'chr' || (min(p_partkey) % 5) AS chr, min(p_partkey % 40) * 1000 AS \"start\", min(p_partkey % 40) * 1000 + 4000 AS \"end\", min(p_type) AS gene_set FROM part GROUP BY 1",
    "weights": "SELECT p_brand AS gene, l_partkey % 200 AS v_idx, avg(l_discount) - 0.05 AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
}
_NEEDS = {"studies": ["variants"], "pvals": ["variants", "studies"]}


def cte(*names: str) -> str:
    """A WITH clause that defines the named views and what they need."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    return "WITH " + ", ".join(f"{x} AS ({SQL[x]})" for x in order) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v_idx, s_idx, dosage): one call for each variant and sample that has any."""
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 200).alias("v_idx"), F.col("l_suppkey").alias("s_idx"))
    return rows.agg((F.min(F.floor("l_quantity").cast("int")) % 3).cast("double").alias("dosage"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v_idx")
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("v_idx")).distinct()
    letter = lambda letters: F.substring(F.lit(letters), (v % 4 + 1).cast("int"), F.lit(1))
    return rows.select(
        "v_idx", F.concat(F.lit("rs"), v).alias("snp"), F.concat(F.lit("chr"), v % 5).alias("chr"), (F.floor(v / 5) * 1000 + 1).alias("pos"), letter("ACGT").alias("a1"), letter("CGTA").alias("a2")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier")
    return rows.select(
        F.col("s_suppkey").alias("s_idx"), (F.col("s_acctbal") / 1000).alias("y"), F.col("s_nationkey").alias("family"), (F.col("s_suppkey") % 7).cast("double").alias("cov"),
        (F.col("s_acctbal") > 5000).cast("int").alias("status"),
    )


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics of three studies: study, v_idx, snp, chr, pos, a1, a2, n, beta, se."""
    y, x = F.col("l_extendedprice") / 1000, F.col("l_discount") * 100
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("study"), (F.col("l_partkey") % 200).alias("v_idx"))
    sums = rows.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"))
    sums = sums.where((F.col("n") > 4) & (F.col("sxx") > 0))
    se = F.sqrt((F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return sums.withColumn("se", se).join(variants(spark, sf_dir), "v_idx").select("study", "v_idx", "snp", "chr", "pos", "a1", "a2", "n", "beta", "se")


def pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = studies(spark, sf_dir).where("study = 'N'")
    return rows.select("v_idx", "snp", "chr", "pos", "beta", "se", "n", F.exp(-F.pow(F.col("beta") / F.col("se"), 2) / 2).alias("p"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene"))
    start = F.min(F.col("p_partkey") % 40) * 1000
    return rows.agg(F.concat(F.lit("chr"), F.min("p_partkey") % 5).alias("chr"), start.alias("start"), (start + 4000).alias("end"), F.min("p_type").alias("gene_set"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("gene"), (F.col("l_partkey") % 200).alias("v_idx")).agg((F.avg("l_discount") - 0.05).alias("weight"))
