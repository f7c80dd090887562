"""Queries without SQL use all of their input."""

import numpy as np
import pandas as pd

from lociframe.functions import specfun
from lociframe.operators import kinship
from lociframe.plans import catalogue, views


def test_ld_of_whole_blocks(spark, sf):
    calls = views.geno(spark, sf).toPandas().pivot(index="s_idx", columns="v_idx", values="dosage")
    at = views.variants(spark, sf).toPandas().set_index("v_idx")
    got = {r.block: r for r in catalogue.queries()["effective_tests"](spark, sf).collect()}
    hits = views.pvals(spark, sf).toPandas()
    for chrom, own in hits.groupby("chr"):
        full = calls[sorted(own["v_idx"])].corr(min_periods=1).fillna(0).to_numpy()
        np.fill_diagonal(full, 1)
        assert got[chrom].n == len(own) and got[chrom].n_effective == kinship.effective_tests(0.9 * full + 0.1 * np.eye(len(own)))
    clumps = catalogue.queries()["clump"](spark, sf).toPandas()
    gap = np.abs(at.loc[clumps["index"], "pos"].to_numpy() - at.loc[clumps["member"], "pos"].to_numpy())
    assert gap.max() > 5000


def test_rank_int_of_all_columns(spark, sf):
    stored = views.read(spark, sf, "embeddings").toPandas()
    wide = pd.DataFrame(np.stack(stored["embedding"].to_numpy()), index=stored["vec_id"])
    got = catalogue.queries()["rank_int"](spark, sf).toPandas().pivot(index="vec_id", columns="feature", values="normal")
    want = specfun.norm_ppf(((wide.rank() - 0.375) / (len(wide) + 0.25)).to_numpy().ravel()).reshape(wide.shape)
    assert got.shape == wide.shape and np.allclose(got.loc[wide.index].to_numpy(), want, atol=1e-6)


def test_gene_sets_of_all_parts(spark, sf):
    got = {r.gene_set: r.n_genes for r in catalogue.queries()["gene_set_enrichment"](spark, sf).collect()}
    part = views.read(spark, sf, "part").toPandas()
    assert got == part.groupby("p_type")["p_brand"].nunique().to_dict()
