import numpy as np
import pytest

from lociframe import api, cli


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A VCF of 60 samples and 40 variants on two chromosomes, a trait driven by the first variant."""
    folder, rng = tmp_path_factory.mktemp("study"), np.random.default_rng(8)
    n, m = 60, 40
    g = rng.binomial(2, 0.4, (n, m))
    y = 1.5 * g[:, 0] + rng.normal(size=n)
    ids = [f"i{k:02d}" for k in range(n)]
    body = "".join(
        f"{1 + k // 20}\t{1000 * (k + 1)}\trs{k}\tA\tG\t.\tPASS\t.\tGT\t" + "\t".join(["0/0", "0/1", "1/1"][x] for x in g[:, k]) + "\n" for k in range(m)
    )
    (folder / "g.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(ids) + "\n" + body)
    level, time = np.digitize(y, [0.5, 2.0]), np.exp(-y) + 0.1
    rows = "".join(f"{i}\t{a:.5f}\t{int(a > 1)}\t{l}\t{t:.5f}\t{k % 4 > 0:d}\t{k % 5}\n" for k, (i, a, l, t) in enumerate(zip(ids, y, level, time)))
    (folder / "p.tsv").write_text("IID\tY\tB\tL\tT\tE\tC\n" + rows + "other\t1\t1\t1\t1\t1\t1\n")
    return folder, g, y


@pytest.mark.parametrize("trait,model,event", [("Y", "auto", None), ("Y", "glm", None), ("Y", "lmm_loco", None), ("B", "auto", None), ("B", "firth", None), ("L", "auto", None), ("L", "multinomial", None), ("T", "cox", "E")])
def test_models_find_the_driver(spark, files, trait, model, event):
    found = api.gwas(spark, str(files[0] / "g.vcf"), str(files[0] / "p.tsv"), trait, ["C"], model, event=event)
    best = found.table.orderBy("p").first()
    assert best.snp == "rs0" and best.p < 1e-3 and best.p_adj < 0.05 and found.n_samples == 60
    assert found.manifest.where("drop_reason = 'no_genotype'").count() == 1


def test_plain_regression(spark, files):
    folder, g, y = files
    rows = {r.snp: r for r in api.gwas(spark, str(folder / "g.vcf"), str(folder / "p.tsv"), "Y", model="glm").table.collect()}
    slope = np.polyfit(g[:, 3], np.round(y, 5), 1)[0]
    assert rows["rs3"].beta == pytest.approx(slope) and rows["rs3"].af == pytest.approx(g[:, 3].mean() / 2)


def test_errors(spark, files):
    with pytest.raises(ValueError, match="model is one of"):
        api.gwas(spark, "x", "y", "Y", model="none")
    assert api.preflight(spark, str(files[0] / "g.vcf"), str(files[0] / "p.tsv"))["n_both"] == 60


def test_commands(spark, files, tmp_path):
    folder = files[0]
    run = lambda *a: cli.main([*a, "--out", f"{tmp_path}/{a[0]}"], spark)
    vcf = str(folder / "g.vcf")
    run("scan", "--genotypes", vcf, "--phenotypes", str(folder / "p.tsv"), "--trait", "Y")
    run("qc", "--genotypes", vcf)
    run("ld-scores", "--genotypes", vcf)
    run("ld-blocks", "--genotypes", vcf, "--method", "big_ld")
    run("grm", "--genotypes", vcf)
    (tmp_path / "s.tsv").write_text("SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n" + "".join(f"rs{k}\t{1 + k // 20}\t{k}\tG\tA\t{0.1 + k / 100}\t{0.05 + k % 7 / 100}\t{(k + 1) / 50}\n" for k in range(40)))
    s = str(tmp_path / "s.tsv")
    run("clump", "--genotypes", vcf, "--sumstats", s, "--p", "0.5")
    run("meta", "--sumstats", f"{s},{s}")
    run("mr", "--exposure", s, "--outcome", s, "--p", "1")
    run("coloc", "--exposure", s, "--outcome", s)
    run("adjust", "--sumstats", s)
    run("pgs-score", "--genotypes", vcf, "--weights", s)
    assert spark.read.parquet(f"{tmp_path}/pgs-score").count() == 60 and spark.read.parquet(f"{tmp_path}/qc").count() == 40
    assert [round(r.beta, 6) for r in spark.read.parquet(f"{tmp_path}/mr").where("method = 'ivw'").collect()] == [1.0]
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/scan").count() > 30


def test_more_models(spark, files):
    for trait, model, event in (("B", "glmm", None), ("L", "ordinal_glmm", None), ("L", "multinomial_glmm", None), ("T", "frailty", "E"), ("Y", "lmm_refit", None), ("Y", "blink", None), ("Y", "farmcpu", None)):
        best = api.gwas(spark, str(files[0] / "g.vcf"), str(files[0] / "p.tsv"), trait, ["C"], model, event=event).table.orderBy("p").first()
        assert best.snp == "rs0", model
    told = api.recommend(spark, str(files[0] / "g.vcf"), str(files[0] / "p.tsv"), "B")
    assert told["trait"] == "binary" and told["model"] == "logistic"


def test_all_commands(spark, files, tmp_path, capsys):
    folder = files[0]
    vcf, pheno = str(folder / "g.vcf"), str(folder / "p.tsv")
    study = ["--genotypes", vcf, "--phenotypes", pheno]

    def run(*a, rows=None):
        out = f"{tmp_path}/{a[0]}-{len(list(tmp_path.iterdir()))}"
        cli.main([*a, "--out", out], spark)
        n = spark.read.parquet(out).count() if rows is not None else None
        assert rows is None or n == rows, (a[0], n)

    for name in ("mvlmm-scan", "met-scan"):
        run(name, *study, "--trait", "Y,T", "--covariates", "C", rows=40)
    run("mtmet-scan", *study, "--trait", "Y,T,B,L", rows=40)
    run("me-glmm-scan", *study, "--trait", "B,E", rows=40)
    run("rr-scan", *study, "--trait", "Y,T,B", "--times", "0,1,2", rows=40)
    run("mklmm-scan", *study, "--trait", "Y", rows=40)
    run("gxe-scan", *study, "--trait", "Y", "--environment", "C", rows=40)
    run("conditional-scan", *study, "--trait", "Y", "--p", "0.001")
    run("ocf-scan", *study, "--trait", "Y", rows=40)
    run("knockoff-scan", *study, "--trait", "Y", "--q", "0.5", rows=40)
    run("bayes-scan", *study, "--trait", "Y", rows=40)
    run("family-scan", *study, "--trait", "Y", "--family", "C")
    run("poly-scan", *study, "--trait", "Y")
    run("mediate", *study, "--trait", "Y", "--mediator", "T", rows=40)
    for method in ("mean", "mode", "knn", "ld", "copying"):
        run("impute", "--genotypes", vcf, "--method", method, rows=2400)
    for method in ("gabriel", "spine", "dp", "cc_graph", "graphical", "aligned", "changepoint"):
        run("ld-blocks", "--genotypes", vcf, "--method", method)
    run("convert", "--genotypes", vcf, "--to", "vcf")
    run("convert", "--genotypes", vcf, "--to", "bed")
    (tmp_path / "s.tsv").write_text("SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\tN\tEAF\n" + "".join(f"rs{k}\t{1 + k // 20}\t{1000 * (k + 1)}\tG\tA\t{0.1 + k % 9 / 100}\t{0.05 + k % 7 / 100}\t{(k + 1) / 50}\t500\t{0.1 + k / 100}\n" for k in range(40)))
    (tmp_path / "t.tsv").write_text((tmp_path / "s.tsv").read_text().replace("\t0.1\t", "\t0.13\t"))
    (tmp_path / "g.bed").write_text("".join(f"{1 + k // 4}\t{5000 * (k % 4)}\t{5000 * (k % 4) + 4000}\tgene{k}\n" for k in range(8)))
    (tmp_path / "sets.tsv").write_text("gene\tgene_set\n" + "".join(f"gene{k}\tset{k % 2}\n" for k in range(8)))
    (tmp_path / "e.tsv").write_text("IID\tgene0\tgene1\n" + "".join(f"i{k:02d}\t{k % 7}\t{k % 5}\n" for k in range(60)))
    s, t, bed = str(tmp_path / "s.tsv"), str(tmp_path / "t.tsv"), str(tmp_path / "g.bed")
    run("set-scan", *study, "--trait", "Y", "--regions", bed)
    run("mediate-scan", *study, "--trait", "Y", "--expression", str(tmp_path / "e.tsv"), "--genes", bed)
    for name in ("finemap", "bayes-scan-rss"):
        run(name, "--genotypes", vcf, "--sumstats", s, rows=40)
    run("hess", "--genotypes", vcf, "--sumstats", s, rows=2)
    run("ldsc", "--genotypes", vcf, "--sumstats", s, "--blocks", "5", rows=1)
    run("ldsc-rg", "--genotypes", vcf, "--sumstats", s, "--other", t, rows=1)
    for method in ("inf", "cs", "ct"):
        run("pgs-fit", "--genotypes", vcf, "--sumstats", s, "--method", method, "--p", "0.5")
    run("mr-mega", "--sumstats", f"{s},{t},{s}")
    run("smr", "--exposure", s, "--outcome", t, rows=2)
    run("power", "--sumstats", s, rows=40)
    run("winners-curse", "--sumstats", s, rows=40)
    run("winners-curse", "--sumstats", s, "--method", "fiqt", rows=40)
    run("gene-set-enrichment", "--sumstats", s, "--genes", bed, "--sets", str(tmp_path / "sets.tsv"), rows=2)
    run("annotate", "--sumstats", s, "--genes", bed, "--p", "1")
    run("pipeline", *study, "--trait", "Y", "--p", "0.01")
    for name in ("validate", "recommend"):
        cli.main([name, *study, *(["--trait", "Y"] if name == "recommend" else [])], spark)
    cli.main(["models"], spark)
    assert "frailty" in capsys.readouterr().out
    import sqlite3

    with sqlite3.connect(tmp_path / "w.db") as con:
        con.execute("CREATE TABLE weights (gene, rsid, weight, ref_allele, eff_allele)")
        con.executemany("INSERT INTO weights VALUES (?, ?, ?, 'A', 'G')", [(f"gene{k % 4}", f"rs{k}", 0.1 + k / 100) for k in range(12)])
    cli.main(["twas-scan", "--sumstats", s, "--weights", str(tmp_path / "w.db"), "--out", str(tmp_path / "twas")], spark)
    run("combine-gwas-twas", "--sumstats", s, "--twas", str(tmp_path / "twas"), "--genes", bed, rows=4)


def test_meta_keeps_every_variant(spark, tmp_path):
    head = "SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n"
    (tmp_path / "a.tsv").write_text(head + "rs1\t1\t1\tA\tG\t0.2\t0.1\t0.1\n")
    (tmp_path / "b.tsv").write_text(head + "rs1\t1\t1\tG\tA\t-0.4\t0.1\t0.1\nrs2\t1\t2\tC\tT\t0.3\t0.1\t0.1\n")
    cli.main(["meta", "--sumstats", f"{tmp_path}/a.tsv,{tmp_path}/b.tsv", "--out", f"{tmp_path}/m"], spark)
    assert {r.snp: (r.k, round(r.beta, 6)) for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {"rs1": (2, 0.3), "rs2": (1, 0.3)}


def test_call(spark, files):
    folder = files[0]
    found = cli.call(spark, "lmm-scan", genotypes=str(folder / "g.vcf"), phenotypes=str(folder / "p.tsv"), trait="Y", covariates="C")
    assert found.orderBy("p").first().snp == "rs0"
    assert cli.call(spark, "ld-scores", genotypes=str(folder / "g.vcf"), window=5000).count() == 40
    assert cli.call(spark, "models") is None
    with pytest.raises(TypeError, match="needs"):
        cli.call(spark, "qc")
    with pytest.raises(TypeError, match="no option"):
        cli.call(spark, "qc", genotypes="x", nothing=1)
    told = cli.manifest()
    assert told["clump"]["options"]["r2"] == {"type": "float", "default": 0.1, "required": False} and len(told) == len(cli.COMMANDS)
