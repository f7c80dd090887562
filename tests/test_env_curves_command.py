import numpy as np

from lociframe import cli


def test_long_measures(spark, tmp_path):
    """Variant 0 acts on the level everywhere; one sample has no curve in the second environment, one no genotypes."""
    rng = np.random.default_rng(8)
    n, m = 60, 200  # few variants would make a relationship that explains the first one away
    g = rng.binomial(2, 0.4, (n, m))
    ids = [f"i{k:02d}" for k in range(n)]
    body = "".join(f"1\t{1000 * (k + 1)}\trs{k}\tA\tG\t.\tPASS\t.\tGT\t" + "\t".join(["0/0", "0/1", "1/1"][v] for v in g[:, k]) + "\n" for k in range(m))
    (tmp_path / "g.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(ids) + "\n" + body)
    rows = [(i, 1.5 * g[k, 0] + rng.normal(), t, e, k % 5) for k, i in enumerate(ids) for e in "ab" for t in range(4) if k or e == "a"] + [("other", 1.0, t, "a", 1) for t in range(4)]
    (tmp_path / "long.tsv").write_text("IID\tY\tday\tplace\tC\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    cli.main(["rr-met-scan", "--genotypes", str(tmp_path / "g.vcf"), "--phenotypes", str(tmp_path / "long.tsv"), "--trait", "Y", "--covariates", "C", "--time", "day", "--environment", "place", "--at", "0,3", "--out", str(tmp_path / "out")], spark)
    found = spark.read.parquet(str(tmp_path / "out")).toPandas().set_index("snp")
    assert len(found) == m, found.index
    assert found["p_mean"].idxmin() == "rs0", found["p_mean"]
    assert found.loc["rs0", "p_all"] < 1e-4, found.loc["rs0"]
    assert found.loc["rs0", "effect_t0_e0"] > 0.5 and found.loc["rs0", "effect_t1_e1"] > 0.5
    # the ordered trait of the sums' levels beside their mean, from the same files
    total = [1.5 * g[k, 0] + rng.normal() for k in range(n)]
    (tmp_path / "wide.tsv").write_text("IID\tA\tB\n" + "".join(f"{i}\t{int(v > 1)}\t{v + rng.normal():.4f}\n" for i, v in zip(ids, total, strict=True)))
    cli.main(["threshold-linear-scan", "--genotypes", str(tmp_path / "g.vcf"), "--phenotypes", str(tmp_path / "wide.tsv"), "--trait", "A,B", "--ordinal", "A", "--out", str(tmp_path / "joint")], spark)
    joint = spark.read.parquet(str(tmp_path / "joint")).toPandas().set_index("snp")
    assert joint.loc["rs0", "p"] < 1e-3 and joint["p"].notna().all()
