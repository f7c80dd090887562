"""Queries: linkage disequilibrium, regions, summary statistics and polygenic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import encode, graph, intervals, ld, pgs, scan, sumstats

from . import views
from .catalogue import register
from .core import CELLS, JOINED, LINEAR, joined, r
from .views import cte

#: Windows of pairs and blocks, clumping, LD scores.
PAIR_WINDOW = 200_000
CLUMP_WINDOW = 250_000
SCORE_WINDOW = 1_000_000


def pairs_sql(window: int) -> str:
    return cte("geno", "variants") + f""", c AS (SELECT * FROM geno JOIN variants USING (v_idx)),
  pairs AS (SELECT a.chr, a.v_idx AS i, b.v_idx AS j, a.pos AS pos_i, b.pos AS pos_j, count(*) AS n, corr(a.dosage, b.dosage) AS r
    FROM c a JOIN c b ON a.chr = b.chr AND a.s_idx = b.s_idx AND b.pos > a.pos AND b.pos <= a.pos + {window} GROUP BY ALL HAVING var_pop(a.dosage) > 0 AND var_pop(b.dosage) > 0) """


PAIRS, CLUMP_PAIRS, SCORE_PAIRS = map(pairs_sql, (PAIR_WINDOW, CLUMP_WINDOW, SCORE_WINDOW))
BOTH = """, both_ways AS (SELECT i AS v_idx, j AS other, pos_j - pos_i AS gap, r * r AS r2 FROM pairs UNION ALL SELECT j, i, pos_j - pos_i, r * r FROM pairs) """


def pairs(spark: SparkSession, sf: str, window: int = PAIR_WINDOW) -> DataFrame:
    return ld.pair_correlations(views.geno(spark, sf), views.variants(spark, sf), window)


@register("ld_pairs_r2", PAIRS + "SELECT chr, i, j, n, round(r * r, 6) AS r2 FROM pairs")
def ld_pairs_r2(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("chr", "i", "j", "n", F.round(F.col("r") * F.col("r"), 6).alias("r2"))


@register(
    "ld_neighbour_pairs",
    cte("variants") + f"SELECT a.chr, a.v_idx AS i, b.v_idx AS j, a.pos AS pos_i, b.pos AS pos_j FROM variants a JOIN variants b ON a.chr = b.chr AND b.pos > a.pos AND b.pos <= a.pos + {PAIR_WINDOW}",
)
def ld_neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.neighbours(views.variants(spark, sf), PAIR_WINDOW)


@register(
    "ld_scores",
    SCORE_PAIRS + BOTH + "SELECT v_idx, round(1 + coalesce(sum(r2), 0), 6) AS ld_score, count(r2) AS n_neighbours FROM variants LEFT JOIN both_ways USING (v_idx) GROUP BY 1",
)
def ld_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ld.scores(pairs(spark, sf, SCORE_WINDOW), views.variants(spark, sf)).select("v_idx", r("ld_score"), "n_neighbours")


@register(
    "ld_decay_signal",
    PAIRS + BOTH + "SELECT v_idx, round(avg(r2), 6) AS signal FROM (SELECT *, row_number() OVER (PARTITION BY v_idx ORDER BY gap, other) AS k FROM both_ways) WHERE k <= 5 GROUP BY 1",
)
def ld_decay_signal(spark: SparkSession, sf: str) -> DataFrame:
    return ld.decay_signal(pairs(spark, sf)).select("v_idx", r("signal"))


@register(
    "blocks_r2_islands",
    PAIRS + """, w AS (SELECT v.v_idx, v.chr, v.pos, lag(v.v_idx) OVER (PARTITION BY v.chr ORDER BY v.pos, v.v_idx) AS previous FROM variants v),
    f AS (SELECT w.*, round(r * r, 9) < 0.01 OR r IS NULL AS s FROM w LEFT JOIN pairs p ON p.i = w.previous AND p.j = w.v_idx),
    b AS (SELECT *, sum(s::INT) OVER (PARTITION BY chr ORDER BY pos, v_idx ROWS UNBOUNDED PRECEDING) AS block FROM f)
    SELECT chr, block::BIGINT AS block, min(pos) AS "start", max(pos) AS "end", count(*) AS n_variants FROM b GROUP BY 1, 2""",
)
def blocks_r2_islands(spark: SparkSession, sf: str) -> DataFrame:
    return ld.adjacent_blocks(views.variants(spark, sf), pairs(spark, sf), 0.01)


HAPLO = cte("geno", "variants") + """, hap AS (SELECT v_idx, s_idx * 2 AS h_idx, (dosage >= 1)::INT AS allele FROM geno UNION ALL SELECT v_idx, s_idx * 2 + 1, (dosage = 2)::INT FROM geno) """


def haplotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Two haplotypes of each sample, the first carrying what the dosage allows."""
    g = views.geno(spark, sf)
    first = g.select("v_idx", (F.col("s_idx") * 2).alias("h_idx"), (F.col("dosage") >= 1).cast("int").alias("allele"))
    return first.unionByName(g.select("v_idx", (F.col("s_idx") * 2 + 1).alias("h_idx"), (F.col("dosage") == 2).cast("int").alias("allele")))


@register(
    "four_gamete_blocks",
    HAPLO + """, w AS (SELECT v_idx, chr, pos, lag(v_idx) OVER (PARTITION BY chr ORDER BY pos, v_idx) AS previous FROM variants),
    g AS (SELECT w.v_idx, count(*) AS n, least(count(*) FILTER (a.allele * 2 + b.allele = 0), count(*) FILTER (a.allele * 2 + b.allele = 1), count(*) FILTER (a.allele * 2 + b.allele = 2), count(*) FILTER (a.allele * 2 + b.allele = 3)) AS l
      FROM w JOIN hap a ON a.v_idx = w.v_idx JOIN hap b ON b.v_idx = w.previous AND a.h_idx = b.h_idx GROUP BY 1),
    b AS (SELECT chr, pos, sum((previous IS NULL OR coalesce(l > 0.12 * n, false))::INT) OVER (PARTITION BY chr ORDER BY pos, v_idx ROWS UNBOUNDED PRECEDING) AS block FROM w LEFT JOIN g USING (v_idx))
    SELECT chr, block::BIGINT AS block, min(pos) AS "start", max(pos) AS "end", count(*) AS n_variants FROM b GROUP BY 1, 2""",
)
def four_gamete_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ld.four_gamete_blocks(haplotypes(spark, sf), views.variants(spark, sf), 0.12)


@register(
    "dprime_pairs",
    HAPLO + """, p AS (SELECT a.v_idx AS i, b.v_idx AS j FROM variants a JOIN variants b ON a.chr = b.chr AND b.pos > a.pos AND b.pos <= a.pos + 200000),
    m AS (SELECT i, j, avg(x.allele * y.allele) AS ab, avg(x.allele) AS a, avg(y.allele) AS b FROM p JOIN hap x ON x.v_idx = i JOIN hap y ON y.v_idx = j AND x.h_idx = y.h_idx GROUP BY 1, 2),
    d AS (SELECT i, j, ab - a * b AS d, CASE WHEN ab - a * b >= 0 THEN least(a * (1 - b), (1 - a) * b) ELSE least(a * b, (1 - a) * (1 - b)) END AS mx FROM m)
    SELECT i, j, round(CASE WHEN mx > 1e-12 THEN abs(d) / mx ELSE 0 END, 6) AS dprime FROM d""",
)
def dprime_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ld.dprime_pairs(haplotypes(spark, sf), intervals.neighbours(views.variants(spark, sf), PAIR_WINDOW)).select("i", "j", r("dprime"))


@register(
    "ld_components",
    PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT i AS a, j AS b FROM pairs WHERE round(r * r, 9) > 0.04 UNION SELECT j, i FROM pairs WHERE round(r * r, 9) > 0.04),
    reach AS (SELECT v_idx AS a, v_idx AS b FROM variants UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
    SELECT a AS v_idx, min(b) AS component FROM reach GROUP BY 1""",
)
def ld_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_components(pairs(spark, sf).where("round(r * r, 9) > 0.04"), views.variants(spark, sf))


def _greedy(order: str, stop: str, members: str) -> str:
    """Recursion over the places of each chromosome: a place that is not taken takes its members."""
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY {order}) AS k FROM pvals WHERE {stop}),
    near AS ({members}),
    walk AS (SELECT chr, 0::BIGINT AS k, NULL::BIGINT AS index, []::BIGINT[] AS own, []::BIGINT[] AS taken FROM (SELECT DISTINCT chr FROM ranked)
      UNION ALL SELECT w.chr, r.k, r.v_idx, CASE WHEN list_contains(taken, r.v_idx) THEN [] ELSE list_filter(others, lambda o: NOT list_contains(taken, o)) END,
        CASE WHEN list_contains(taken, r.v_idx) THEN taken ELSE list_concat(taken, others) END
      FROM walk w JOIN ranked r ON r.chr = w.chr AND r.k = w.k + 1 JOIN near USING (v_idx)) """


@register(
    "clump",
    CLUMP_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f", studies AS ({views.SQL['studies']}), pvals AS ({views.SQL['pvals']})" + BOTH
    + _greedy("p, v_idx", "p <= 0.5", "SELECT p.v_idx, list_prepend(p.v_idx, coalesce(list(other) FILTER (r2 >= 0.02), [])) AS others FROM pvals p LEFT JOIN both_ways b ON b.v_idx = p.v_idx GROUP BY 1")
    + "SELECT chr, index, unnest(own) AS member FROM walk WHERE k > 0",
)
def clump(spark: SparkSession, sf: str) -> DataFrame:
    return ld.clump(views.pvals(spark, sf), pairs(spark, sf, CLUMP_WINDOW), 0.5, 0.02)


@register(
    "prune_peaks",
    cte("pvals").replace("WITH ", "WITH RECURSIVE ", 1)
    + _greedy("p, pos, v_idx", "p <= 0.3", "SELECT a.v_idx, list(b.v_idx) AS others FROM ranked a JOIN ranked b ON a.chr = b.chr AND abs(a.pos - b.pos) <= 6000 GROUP BY 1")
    + """SELECT w.chr, index AS v_idx, len(own) AS n, greatest(0, pos - 3000) AS "start", pos + 3000 AS "end" FROM walk w JOIN pvals ON v_idx = index WHERE len(own) > 0""",
)
def prune_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return ld.prune_peaks(views.pvals(spark, sf), 0.3, 6000)


REGION = cte("variants", "genes")


@register("region_variants", REGION + """SELECT gene, count(*) AS n, min(v_idx) AS first_v, max(v_idx) AS last_v FROM genes g JOIN variants v ON g.chr = v.chr AND pos >= "start" AND pos < "end" GROUP BY 1""")
def region_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = intervals.range_join(views.variants(spark, sf), views.genes(spark, sf), "start", "end")
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.min("v_idx").alias("first_v"), F.max("v_idx").alias("last_v"))


@register(
    "snp_to_gene",
    cte("pvals", "genes") + """, j AS (SELECT gene, power(beta / se, 2) AS chi2 FROM genes g JOIN pvals v ON g.chr = v.chr AND pos >= "start" - 2000 AND pos <= "end" + 2000)
    SELECT gene, count(chi2) AS k, round(coalesce(avg(chi2), 0), 6) AS stat, round(coalesce((avg(chi2) - 1) / sqrt(2 / count(chi2)), 0), 6) AS z FROM genes LEFT JOIN j USING (gene) GROUP BY 1""",
)
def snp_to_gene(spark: SparkSession, sf: str) -> DataFrame:
    wide = views.genes(spark, sf).withColumns({"lo": F.col("start") - 2000, "hi": F.col("end") + 2000}).select("gene", "chr", "lo", "hi")
    hit = intervals.range_join(views.pvals(spark, sf).select("chr", "pos", "beta", "se"), wide, "lo", "hi", closed=True)
    sums = hit.groupBy("gene").agg(F.count("*").alias("k"), F.avg(F.pow(F.col("beta") / F.col("se"), 2)).alias("stat"))
    rows = views.genes(spark, sf).select("gene").join(sums, "gene", "left")
    return rows.select(
        "gene", F.coalesce("k", F.lit(0)).alias("k"), F.round(F.coalesce("stat", F.lit(0.0)), 6).alias("stat"),
        F.round(F.coalesce((F.col("stat") - 1) / F.sqrt(2 / F.col("k")), F.lit(0.0)), 6).alias("z"),
    )


@register("cis_pairs", cte("variants", "genes") + """SELECT gene, v_idx, pos - "start" AS distance FROM genes g JOIN variants v ON g.chr = v.chr AND pos >= "start" - 3000 AND pos <= "start" + 3000""")
def cis_pairs(spark: SparkSession, sf: str) -> DataFrame:
    wide = views.genes(spark, sf).withColumns({"lo": F.col("start") - 3000, "hi": F.col("start") + 3000}).select("gene", "chr", "start", "lo", "hi")
    return intervals.range_join(views.variants(spark, sf), wide, "lo", "hi", closed=True).select("gene", "v_idx", (F.col("pos") - F.col("start")).alias("distance"))


@register(
    "annotate_hits",
    cte("pvals", "genes") + """, h AS (SELECT * FROM pvals WHERE p < 0.3), j AS (SELECT v_idx, gene, row_number() OVER (PARTITION BY v_idx ORDER BY least(abs(pos - "start"), abs(pos - "end")), gene) AS k
      FROM h JOIN genes g ON g.chr = h.chr AND pos >= "start" AND pos <= "end") SELECT h.v_idx, snp, gene FROM h LEFT JOIN (SELECT * FROM j WHERE k = 1) j ON h.v_idx = j.v_idx""",
)
def annotate_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = views.pvals(spark, sf).where("p < 0.3")
    near = intervals.range_join(hits, views.genes(spark, sf).select("gene", "chr", "start", "end"), "start", "end", closed=True)
    gap = F.least(F.abs(F.col("pos") - F.col("start")), F.abs(F.col("pos") - F.col("end")))
    return hits.select("v_idx", "snp").join(near.groupBy("v_idx").agg(F.min_by("gene", F.struct(gap, "gene")).alias("gene")), "v_idx", "left")


@register(
    "burden_sum_by_region",
    cte("geno", "variants", "genes") + """SELECT gene, s_idx, sum(dosage) AS burden, count(*) AS n FROM genes g JOIN variants v ON g.chr = v.chr AND pos >= "start" AND pos < "end" JOIN geno USING (v_idx) GROUP BY 1, 2""",
)
def burden_sum_by_region(spark: SparkSession, sf: str) -> DataFrame:
    hit = intervals.range_join(views.variants(spark, sf), views.genes(spark, sf), "start", "end").select("gene", "v_idx")
    return hit.join(views.geno(spark, sf), "v_idx").groupBy("gene", "s_idx").agg(F.sum("dosage").alias("burden"), F.count("*").alias("n"))


TWO = cte("studies") + ", inst AS (SELECT x.snp, x.v_idx, x.chr, x.beta AS bx, x.se AS sx, y.beta AS ey, y.se AS sy FROM studies x JOIN studies y USING (snp) WHERE x.study = 'N' AND y.study = 'R') "


def inst(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.studies(spark, sf)
    return sumstats.instruments(rows.where("study = 'N'"), rows.where("study = 'R'"))


@register(
    "align_sumstats",
    cte("studies") + """, o AS (SELECT snp, CASE WHEN v_idx % 3 = 0 THEN a2 ELSE a1 END AS a1, CASE WHEN v_idx % 3 = 0 THEN a1 WHEN v_idx % 5 = 0 THEN 'X' ELSE a2 END AS a2, beta FROM studies WHERE study = 'R')
    SELECT snp, o.a1 = f.a2 AND o.a2 = f.a1 AS flipped, round(CASE WHEN o.a1 = f.a2 AND o.a2 = f.a1 THEN -o.beta ELSE o.beta END, 6) AS beta,
      CASE WHEN o.a1 = f.a2 AND o.a2 = f.a1 THEN f.a1 ELSE o.a1 END AS a1 FROM o JOIN (SELECT * FROM studies WHERE study = 'N') f USING (snp)""",
)
def align_sumstats(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.studies(spark, sf)
    third = F.col("v_idx") % 3 == 0
    other = rows.where("study = 'R'").select(
        "snp", F.when(third, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(third, F.col("a1")).when(F.col("v_idx") % 5 == 0, "X").otherwise(F.col("a2")).alias("a2"), "beta"
    )
    return sumstats.align(rows.where("study = 'N'"), other).select("snp", "flipped", r("beta"), "a1")


FIXED = cte("studies") + """, m AS (SELECT snp, count(*) AS k, sum(1 / se ** 2) AS w, sum(1 / se ** 4) AS w2, sum(beta / se ** 2) AS wb, sum(beta * beta / se ** 2) AS wbb FROM studies GROUP BY 1),
  q AS (SELECT *, greatest(wbb - wb * wb / w, 0) AS q FROM m),
  fixed AS (SELECT snp, k, wb / w AS beta, sqrt(1 / w) AS se, q, CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) ELSE 0 END AS i2, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / (w - w2 / w)) ELSE 0 END AS tau2 FROM q) """


@register("meta_fixed", FIXED + "SELECT snp, k, round(beta, 6) AS beta, round(se, 6) AS se, round(q, 6) AS q, round(i2, 6) AS i2 FROM fixed")
def meta_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.meta_fixed(views.studies(spark, sf)).select("snp", "k", r("beta"), r("se"), r("q"), r("i2"))


@register(
    "meta_random",
    FIXED + "SELECT snp, round(sum(s.beta / (s.se ** 2 + tau2)) / sum(1 / (s.se ** 2 + tau2)), 6) AS beta, round(sqrt(1 / sum(1 / (s.se ** 2 + tau2))), 6) AS se FROM studies s JOIN fixed USING (snp) GROUP BY 1",
)
def meta_random(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.meta_random(views.studies(spark, sf)).select("snp", r("beta"), r("se"))


@register(
    "mantra_bf",
    cte("studies") + """, m AS (SELECT snp, sum(1 / se ** 2) AS w, sum(beta / se ** 2) AS wb, sum(0.5 * ln((1 / (25 + 1 / se ** 2)) / 0.04) + 0.5 * (beta / se ** 2 / (25 + 1 / se ** 2)) ** 2 * (25 + 1 / se ** 2)) AS h FROM studies GROUP BY 1),
    c AS (SELECT snp, h, 0.5 * ln(1 / (25 + w) / 0.04) + 0.5 * (wb / (25 + w)) ** 2 * (25 + w) AS c FROM m)
    SELECT snp, round(c, 6) AS log_bf_shared, round(h, 6) AS log_bf_separate, round(greatest(c, h) + ln(0.5) + ln(exp(c - greatest(c, h)) + exp(h - greatest(c, h))), 6) AS log_bf FROM c""",
)
def mantra_bf(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.mantra(views.studies(spark, sf)).select("snp", r("log_bf_shared"), r("log_bf_separate"), r("log_bf"))


@register(
    "mr_ivw",
    TWO + """, m AS (SELECT count(*) AS k, sum(bx * ey / sy ** 2) AS xy, sum(bx * bx / sy ** 2) AS xx, sum(ey * ey / sy ** 2) AS yy FROM inst)
    SELECT k, round(xy / xx, 6) AS beta, round(sqrt(1 / xx) * sqrt(greatest(1, (yy - xy * xy / xx) / (k - 1))), 6) AS se, round(yy - xy * xy / xx, 6) AS q FROM m""",
)
def mr_ivw(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.mr_ivw(inst(spark, sf)).select("k", r("beta"), r("se"), r("q"))


@register(
    "mr_egger_coef",
    TWO + """, o AS (SELECT abs(bx) AS x, ey * sign(bx) AS y, 1 / sy ** 2 AS w FROM inst),
    m AS (SELECT count(*) AS k, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM o),
    d AS (SELECT *, w * xx - x * x AS det, (w * xy - x * y) / (w * xx - x * x) AS slope, (xx * y - x * xy) / (w * xx - x * x) AS intercept FROM m)
    SELECT k, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt(greatest((yy - slope * xy - intercept * y) / (k - 2), 1) * w / det), 6) AS se_slope FROM d""",
)
def mr_egger_coef(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.mr_egger(inst(spark, sf)).select("k", r("slope"), r("intercept"), r("se_slope"))


@register(
    "mr_weighted_median",
    TWO + """, o AS (SELECT snp, ey / bx AS ratio, bx * bx / sy ** 2 AS w FROM inst WHERE bx <> 0),
    a AS (SELECT snp, ratio, (sum(w) OVER (ORDER BY ratio, snp ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER () AS ut FROM o),
    n AS (SELECT *, lead(ut) OVER (ORDER BY ratio, snp) AS na, lead(ratio) OVER (ORDER BY ratio, snp) AS nr FROM a)
    SELECT round(ratio + (nr - ratio) * (0.5 - ut) / (na - ut), 6) AS beta FROM n WHERE ut < 0.5 AND na >= 0.5""",
)
def mr_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.mr_weighted_median(inst(spark, sf)).select(r("beta"))


@register(
    "coloc_pairwise",
    TWO + """, l AS (SELECT chr, 0.5 * ln(1 - 0.0225 / (0.0225 + sx ** 2)) + 0.5 * 0.0225 / (0.0225 + sx ** 2) * (bx / sx) ** 2 AS l1, 0.5 * ln(1 - 0.0225 / (0.0225 + sy ** 2)) + 0.5 * 0.0225 / (0.0225 + sy ** 2) * (ey / sy) ** 2 AS l2 FROM inst),
    s AS (SELECT chr, count(*) AS n, ln(sum(exp(l1))) AS s1, ln(sum(exp(l2))) AS s2, ln(sum(exp(l1 + l2))) AS s12 FROM l GROUP BY 1),
    t AS (SELECT chr, n, 1 AS t0, exp(s1) * 1e-4 AS t1, exp(s2) * 1e-4 AS t2, greatest(exp(s1 + s2) - exp(s12), 0) * 1e-8 AS t3, exp(s12) * 1e-5 AS t4 FROM s)
    SELECT chr, n, round(t0 / (t0 + t1 + t2 + t3 + t4), 6) AS pp0, round(t1 / (t0 + t1 + t2 + t3 + t4), 6) AS pp1, round(t2 / (t0 + t1 + t2 + t3 + t4), 6) AS pp2, round(t3 / (t0 + t1 + t2 + t3 + t4), 6) AS pp3,
      round(t4 / (t0 + t1 + t2 + t3 + t4), 6) AS pp4 FROM t""",
)
def coloc_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    rows = inst(spark, sf).join(views.variants(spark, sf).select("snp", "chr"), "snp")
    return sumstats.coloc(rows, ["chr"]).select("chr", "n", *(r(f"pp{k}") for k in range(5)))


EQTL = TWO + ", e AS (SELECT 'g' || (v_idx % 12) AS gene, * FROM inst) "


def eqtl(spark: SparkSession, sf: str) -> DataFrame:
    return inst(spark, sf).join(views.variants(spark, sf).select("snp", "v_idx"), "snp").withColumn("gene", F.concat(F.lit("g"), F.col("v_idx") % 12))


@register(
    "smr",
    EQTL + """SELECT gene, snp, round(ey / bx, 6) AS beta_smr, round((bx / sx) ** 2 * (ey / sy) ** 2 / ((bx / sx) ** 2 + (ey / sy) ** 2), 6) AS chi2
    FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY abs(bx / sx) DESC, snp) AS k FROM e) WHERE k = 1""",
)
def smr(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.smr(eqtl(spark, sf)).select("gene", "snp", r("beta_smr"), r("chi2"))


@register(
    "heidi_stat",
    EQTL + """, k AS (SELECT gene, ey / bx AS ratio, (sy / bx) ** 2 + (ey * sx / bx ** 2) ** 2 AS var, row_number() OVER (PARTITION BY gene ORDER BY abs(bx / sx) DESC, snp) AS k FROM e WHERE bx <> 0)
    SELECT gene, count(*) AS n, round(sum((a.ratio - b.ratio) ** 2 / (a.var + b.var)), 6) AS heidi FROM k a JOIN (SELECT * FROM k WHERE k = 1) b USING (gene) WHERE a.k BETWEEN 2 AND 21 GROUP BY 1""",
)
def heidi_stat(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.heidi(eqtl(spark, sf), most=20).select("gene", "n", r("heidi"))


TWAS = cte("pvals", "weights") + ", t AS (SELECT gene, count(*) AS n_snps, sum(weight * beta / se) / sqrt(sum(weight * weight)) AS z FROM weights JOIN pvals USING (v_idx) GROUP BY 1) "


@register("twas_sumstat", TWAS + "SELECT gene, n_snps, round(z, 6) AS z FROM t")
def twas_sumstat(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.twas(views.weights(spark, sf), views.pvals(spark, sf)).select("gene", "n_snps", r("z"))


@register(
    "twas_individual",
    cte("geno", "samples", "weights") + """, x AS (SELECT gene, s_idx, sum(weight * dosage) AS grex FROM weights JOIN geno USING (v_idx) GROUP BY 1, 2)
    SELECT gene, count(*) AS n, round(regr_slope(y, grex), 4) AS beta, round(corr(y, grex), 6) AS r FROM x JOIN samples USING (s_idx) GROUP BY 1""",
)
def twas_individual(spark: SparkSession, sf: str) -> DataFrame:
    grex = views.geno(spark, sf).join(views.weights(spark, sf), "v_idx").groupBy("gene", "s_idx").agg(F.sum(F.col("weight") * F.col("dosage")).alias("grex"))
    rows = grex.join(views.samples(spark, sf), "s_idx")
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "grex"), 4).alias("beta"), F.round(F.corr("y", "grex"), 6).alias("r"))


STACK = cte("studies", "weights") + ", t AS (SELECT study AS tissue, gene, count(*) AS n_snps, sum(weight * beta / se) / sqrt(sum(weight * weight)) AS z FROM weights JOIN studies USING (v_idx) GROUP BY 1, 2) "


def stacked(spark: SparkSession, sf: str) -> DataFrame:
    rows, w = views.studies(spark, sf), views.weights(spark, sf)
    parts = [sumstats.twas(w, rows.where(F.col("study") == s)).withColumn("tissue", F.lit(s)) for s in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("multi_tissue_stack", STACK + "SELECT tissue, gene, n_snps, round(z, 6) AS z FROM t")
def multi_tissue_stack(spark: SparkSession, sf: str) -> DataFrame:
    return stacked(spark, sf).select("tissue", "gene", "n_snps", r("z"))


@register(
    "multi_tissue_aggregate",
    STACK + """SELECT gene, count(*) AS n_tissues, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_sd, round(sum(z * z), 6) AS chi2,
      arg_max(tissue, abs(z)) AS driver FROM t GROUP BY 1""",
)
def multi_tissue_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.multi_tissue(stacked(spark, sf)).select("gene", "n_tissues", r("z_min"), r("z_max"), r("z_mean"), r("z_sd"), r("chi2"), "driver")


@register(
    "combine_gwas_twas",
    cte("pvals", "weights", "genes") + """, t AS (SELECT gene, exp(-power(sum(weight * beta / se) / sqrt(sum(weight * weight)), 2) / 2) AS p_twas FROM weights JOIN pvals USING (v_idx) GROUP BY 1),
    g AS (SELECT gene, min(p) AS p_gwas FROM genes g JOIN pvals v ON g.chr = v.chr AND pos >= "start" - 5000 AND pos <= "end" + 5000 GROUP BY 1)
    SELECT gene, round(p_gwas, 6) AS p_gwas, round(p_twas, 6) AS p_twas, round(0.5 - atan((tan((0.5 - p_gwas) * pi()) + tan((0.5 - p_twas) * pi())) / 2) / pi(), 6) AS p_combined FROM g JOIN t USING (gene)""",
)
def combine_gwas_twas(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators.combine import cauchy_sf, cauchy_term

    gwas = views.pvals(spark, sf)
    wide = views.genes(spark, sf).withColumns({"lo": F.col("start") - 5000, "hi": F.col("end") + 5000}).select("gene", "chr", "lo", "hi")
    best = intervals.range_join(gwas, wide, "lo", "hi", closed=True).groupBy("gene").agg(F.min("p").alias("p_gwas"))
    genes = sumstats.twas(views.weights(spark, sf), gwas).withColumn("p_twas", F.exp(-F.pow("z", 2) / 2))
    both = best.join(genes, "gene").withColumn("t", (cauchy_term(F.col("p_gwas")) + cauchy_term(F.col("p_twas"))) / 2)
    return both.select("gene", r("p_gwas"), r("p_twas"), F.round(cauchy_sf(F.col("t")), 6).alias("p_combined"))


@register("power_ncp", cte("pvals", "geno") + ", f AS (SELECT v_idx, avg(dosage) / 2 AS af FROM geno GROUP BY 1) SELECT v_idx, round(2 * n * af * (1 - af) * beta * beta, 6) AS ncp FROM pvals JOIN f USING (v_idx)")
def power_ncp(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators import qc

    rows = views.pvals(spark, sf).join(qc.allele_frequency(views.geno(spark, sf)), "v_idx")
    return sumstats.power_ncp(rows).select("v_idx", r("ncp"))


@register(
    "ldsc_moments",
    SCORE_PAIRS + BOTH + f""", studies AS ({views.SQL["studies"]}), p AS (SELECT v_idx, n, (beta / se) ** 2 AS chi2 FROM studies WHERE study = 'N'),
    l AS (SELECT v_idx, 1 + coalesce(sum(r2), 0) AS l FROM variants LEFT JOIN both_ways USING (v_idx) GROUP BY 1), x AS (SELECT chi2, l * n / avg(n) OVER () AS x, avg(n) OVER () AS nbar FROM p JOIN l USING (v_idx))
    SELECT round(regr_slope(chi2, x), 5) AS slope, round(regr_intercept(chi2, x), 5) AS intercept, round(avg(chi2), 6) AS mean_chi2, round(regr_slope(chi2, x) * 200 / max(nbar), 5) AS h2 FROM x""",
)
def ldsc_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pvals(spark, sf).withColumn("chi2", F.pow(F.col("beta") / F.col("se"), 2)).join(ld.scores(pairs(spark, sf, SCORE_WINDOW), views.variants(spark, sf)), "v_idx")
    return sumstats.ldsc_moments(rows, 200).select(r("slope", 5), r("intercept", 5), r("mean_chi2"), r("h2", 5))


PIP = cte("pvals") + """, l AS (SELECT chr, v_idx, 0.5 * ln(1 - 0.0225 / (0.0225 + se ** 2)) + 0.5 * 0.0225 / (0.0225 + se ** 2) * (beta / se) ** 2 AS l FROM pvals),
  pip AS (SELECT chr, v_idx, exp(l) / sum(exp(l)) OVER (PARTITION BY chr) AS pip FROM l) """


@register("finemap_pip", PIP + "SELECT chr, v_idx, round(pip, 6) AS pip FROM pip")
def finemap_pip(spark: SparkSession, sf: str) -> DataFrame:
    return sumstats.posterior(views.pvals(spark, sf), ["chr"]).select("chr", "v_idx", r("pip"))


@register(
    "credible_set",
    PIP + """SELECT chr, v_idx FROM (SELECT *, sum(round(pip, 9)) OVER (PARTITION BY chr ORDER BY round(pip, 9) DESC, v_idx ROWS UNBOUNDED PRECEDING) AS upto FROM pip) WHERE upto - round(pip, 9) < 0.5""",
)
def credible_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = sumstats.posterior(views.pvals(spark, sf), ["chr"]).withColumn("pip", F.round("pip", 9))
    return sumstats.credible_set(rows, ["chr"], coverage=0.5).select("chr", "v_idx")


@register(
    "iclass",
    """WITH x AS (SELECT vec_id AS env, k AS factor, embedding[k] AS loading FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
    c AS (SELECT env, string_agg(CASE WHEN abs(loading) < 0.05 THEN 'Z' WHEN loading > 0 THEN 'P' ELSE 'N' END, '' ORDER BY factor) AS class FROM x GROUP BY 1)
    SELECT class, count(*) AS n, string_agg(env::VARCHAR, ',' ORDER BY env::VARCHAR) AS members FROM c GROUP BY 1""",
)
def iclass(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("env"), F.posexplode("embedding").alias("factor", "loading"))
    return sumstats.polarity_classes(rows, 0.05)


HARM = cte("variants") + """, s AS (SELECT snp, v_idx, CASE v_idx % 4 WHEN 0 THEN a1 WHEN 1 THEN a2 WHEN 2 THEN translate(a1, 'ACGT', 'TGCA') ELSE 'N' END AS x1,
  CASE v_idx % 4 WHEN 0 THEN a2 WHEN 1 THEN a1 WHEN 2 THEN translate(a2, 'ACGT', 'TGCA') ELSE a2 END AS x2, (v_idx % 10) / 10 AS af FROM variants) """


@register(
    "pgs_harmonize",
    HARM + """SELECT snp, status, CASE WHEN status IN ('swapped', 'flipped_swapped') THEN -1 ELSE 1 END AS sign FROM (
    SELECT s.snp, CASE WHEN translate(x1, 'ACGT', 'TGCA') = x2 AND abs(af - 0.5) < 0.08 THEN 'ambiguous' WHEN x1 = a1 AND x2 = a2 THEN 'direct' WHEN x1 = a2 AND x2 = a1 THEN 'swapped'
      WHEN translate(x1, 'ACGT', 'TGCA') = a1 AND translate(x2, 'ACGT', 'TGCA') = a2 THEN 'flipped' WHEN translate(x1, 'ACGT', 'TGCA') = a2 AND translate(x2, 'ACGT', 'TGCA') = a1 THEN 'flipped_swapped' ELSE 'mismatch' END AS status
    FROM s JOIN variants USING (snp))""",
)
def pgs_harmonize(spark: SparkSession, sf: str) -> DataFrame:
    v = views.variants(spark, sf)
    kind = F.col("v_idx") % 4
    other = lambda c: F.translate(F.col(c), "ACGT", "TGCA")
    source = v.select(
        "snp", F.when(kind == 0, F.col("a1")).when(kind == 1, F.col("a2")).when(kind == 2, other("a1")).otherwise("N").alias("a1"),
        F.when(kind == 0, F.col("a2")).when(kind == 1, F.col("a1")).when(kind == 2, other("a2")).otherwise(F.col("a2")).alias("a2"), (F.col("v_idx") % 10 / 10).alias("af"),
    )
    return sumstats.harmonize(v, source).select("snp", "status", "sign")


SCORED = CELLS + """, weights AS (SELECT l_partkey % 200 AS v_idx, avg(l_discount) - 0.05 AS weight FROM lineitem GROUP BY 1),
  pgs AS (SELECT s_idx, sum(weight * d) AS pgs, count(*) AS n_used FROM (SELECT v_idx, s_idx, coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)) AS d FROM cells) JOIN weights USING (v_idx) GROUP BY 1) """


def scored(spark: SparkSession, sf: str) -> DataFrame:
    w = views.read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 200).alias("v_idx")).agg((F.avg("l_discount") - 0.05).alias("weight"))
    cells = encode.dense(views.geno(spark, sf), views.variants(spark, sf), views.samples(spark, sf))
    return pgs.score(cells, w).join(views.samples(spark, sf), "s_idx")


@register("pgs_score", SCORED + "SELECT s_idx, round(pgs, 6) AS pgs, n_used FROM pgs")
def pgs_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("s_idx", r("pgs"), "n_used")


@register("pgs_r2", SCORED + "SELECT count(*) AS n, round(corr(y, pgs), 6) AS pearson, round(regr_r2(y, pgs), 6) AS r2 FROM pgs JOIN samples USING (s_idx)")
def pgs_r2(spark: SparkSession, sf: str) -> DataFrame:
    return pgs.r_squared(scored(spark, sf)).select("n", r("pearson"), r("r2"))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@register("pgs_spearman", SCORED + f", k AS (SELECT {_RANK.format(c='round(pgs, 9)')} AS rx, {_RANK.format(c='y')} AS ry FROM pgs JOIN samples USING (s_idx)) SELECT round(corr(rx, ry), 6) AS spearman FROM k")
def pgs_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return pgs.spearman(scored(spark, sf).withColumn("pgs", F.round("pgs", 9))).select(r("spearman"))


@register(
    "pgs_auc",
    SCORED + f""", k AS (SELECT status, {_RANK.format(c='round(pgs, 9)')} AS x FROM pgs JOIN samples USING (s_idx)),
    m AS (SELECT sum(x) FILTER (status = 1) AS r1, count(*) FILTER (status = 1) AS n1, count(*) FILTER (status = 0) AS n0 FROM k) SELECT n1, n0, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM m""",
)
def pgs_auc(spark: SparkSession, sf: str) -> DataFrame:
    return pgs.auc(scored(spark, sf).withColumn("pgs", F.round("pgs", 9))).select("n1", "n0", r("auc"))


@register(
    "lgebv_blocks",
    cte("geno", "variants") + """, weights AS (SELECT l_partkey % 200 AS v_idx, avg(l_discount) - 0.05 AS weight FROM lineitem GROUP BY 1),
    b AS (SELECT chr || ':' || (pos // 10000) AS block, s_idx, sum(weight * dosage) AS v FROM geno JOIN variants USING (v_idx) JOIN weights USING (v_idx) GROUP BY 1, 2)
    SELECT block, count(*) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM b GROUP BY 1""",
)
def lgebv_blocks(spark: SparkSession, sf: str) -> DataFrame:
    w = views.read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 200).alias("v_idx")).agg((F.avg("l_discount") - 0.05).alias("weight"))
    blocks = views.variants(spark, sf).select("v_idx", F.concat_ws(":", "chr", F.floor(F.col("pos") / 10000).cast("string")).alias("block"))
    rows = pgs.block_values(views.geno(spark, sf), w, blocks)
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 6).alias("variance"))


@register(
    "multi_env_contrast",
    JOINED + """, e AS (SELECT v_idx, family % 3 AS env, regr_slope(y, dosage) AS beta FROM j GROUP BY 1, 2 HAVING regr_sxx(y, dosage) > 0)
    SELECT v_idx, round(avg(beta), 6) AS alpha, round(max(beta) - min(beta), 6) AS spread, count(*) AS n_env FROM e GROUP BY 1""",
)
def multi_env_contrast(spark: SparkSession, sf: str) -> DataFrame:
    y, d = F.col("y"), F.col("dosage")
    rows = joined(spark, sf).groupBy("v_idx", (F.col("family") % 3).alias("env")).agg(F.regr_slope(y, d).alias("beta"), F.regr_sxx(y, d).alias("sxx")).where("sxx > 0")
    return rows.groupBy("v_idx").agg(F.round(F.avg("beta"), 6).alias("alpha"), F.round(F.max("beta") - F.min("beta"), 6).alias("spread"), F.count("*").alias("n_env"))


@register(
    "phenotype_pivot",
    """SELECT o_custkey % 50 AS id, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '1%') / 1000, 6) AS e1, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '2%') / 1000, 6) AS e2,
      round(avg(o_totalprice) FILTER (o_orderpriority LIKE '3%') / 1000, 6) AS e3, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '4%') / 1000, 6) AS e4,
      round(avg(o_totalprice) FILTER (o_orderpriority LIKE '5%') / 1000, 6) AS e5 FROM orders GROUP BY 1""",
)
def phenotype_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("id"), F.concat(F.lit("e"), F.substring("o_orderpriority", 1, 1)).alias("env"), "o_totalprice")
    names = ["e1", "e2", "e3", "e4", "e5"]
    wide = rows.groupBy("id").pivot("env", names).agg(F.avg("o_totalprice") / 1000)
    return wide.select("id", *(r(e) for e in names))


@register(
    "transition_counts",
    cte("geno", "variants") + """, n AS (SELECT v_idx, dosage::INT AS g0, lead(dosage) OVER (PARTITION BY chr, s_idx ORDER BY pos)::INT AS g1 FROM geno JOIN variants USING (v_idx))
    SELECT v_idx, g0, g1, count(*) AS n FROM n WHERE g1 IS NOT NULL GROUP BY 1, 2, 3""",
)
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = views.geno(spark, sf).join(views.variants(spark, sf), "v_idx")
    nxt = F.lead("dosage").over(Window.partitionBy("chr", "s_idx").orderBy("pos")).cast("int")
    return rows.select("v_idx", F.col("dosage").cast("int").alias("g0"), nxt.alias("g1")).where("g1 IS NOT NULL").groupBy("v_idx", "g0", "g1").agg(F.count("*").alias("n"))


@register("scan_by_chr", JOINED.replace("WITH ", f"WITH variants AS ({views.SQL['variants']}), ", 1) + LINEAR + "SELECT chr, count(*) AS n, round(max(abs(beta / se)), 6) AS top FROM lin JOIN variants USING (v_idx) GROUP BY 1")
def scan_by_chr(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.linear(joined(spark, sf)).join(views.variants(spark, sf), "v_idx")
    return rows.groupBy("chr").agg(F.count("*").alias("n"), F.round(F.max(F.abs("stat")), 6).alias("top"))
