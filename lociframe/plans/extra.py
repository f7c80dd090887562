"""Queries: block detection, evidence combination, shrinkage corrections, further tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import blocks, dprime, evidence, intervals, ld, sumstats

from . import views
from .catalogue import register
from .core import CELLS, cells, r, study_p
from .models import chromosome_stats
from .post import EQTL, PAIR_WINDOW, PAIRS, eqtl, inst, pairs
from .tails import chi2_sf, norm_cdf, norm_ppf, norm_sf2, t_sf2
from .views import cte

def tables(spark: SparkSession, sf: str) -> DataFrame:
    return ld.genotype_tables(views.geno(spark, sf), views.variants(spark, sf), PAIR_WINDOW)


def with_dprime(spark: SparkSession, sf: str) -> DataFrame:
    d = dprime.pair_dprime(tables(spark, sf)).select("i", "j", "dprime", "low", "high")
    return pairs(spark, sf, PAIR_WINDOW).join(d, ["i", "j"])


TABLES = PAIRS + """, g AS (SELECT a.chr, a.v_idx AS i, b.v_idx AS j, a.pos AS pos_i, b.pos AS pos_j, a.dosage::INT * 3 + b.dosage::INT AS k, count(*) AS n
    FROM c a JOIN c b ON a.chr = b.chr AND a.s_idx = b.s_idx AND b.pos > a.pos AND b.pos <= a.pos + 200000 GROUP BY ALL),
  tab AS (SELECT i, j, sum(n) AS n, """ + ", ".join(f"coalesce(sum(n) FILTER (k = {k}), 0) AS c{k}" for k in range(9)) + """ FROM g GROUP BY 1, 2),
  f AS (SELECT *, least(greatest((2 * (c6 + c7 + c8) + c3 + c4 + c5) / (2 * n), 1e-10), 1 - 1e-10) AS p, least(greatest((2 * (c2 + c5 + c8) + c1 + c4 + c7) / (2 * n), 1e-10), 1 - 1e-10) AS q FROM tab) """


@register("genotype_tables", TABLES + "SELECT i, j, n::BIGINT AS n, " + ", ".join(f"c{k}::BIGINT AS c{k}" for k in range(9)) + " FROM tab")
def genotype_tables(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf).select("i", "j", "n", *(F.col("c")[k].cast("long").alias(f"c{k}") for k in range(9)))


_H = {"h0": "p * q + d", "h1": "p * (1 - q) - d", "h2": "(1 - p) * q - d", "h3": "(1 - p) * (1 - q) + d"}
#: Chance of each pair of genotypes from the four haplotypes, by rows of the first variant.
_CHANCE = ["h3 * h3", "2 * h2 * h3", "h2 * h2", "2 * h1 * h3", "2 * (h0 * h3 + h1 * h2)", "2 * h0 * h2", "h1 * h1", "2 * h0 * h1", "h0 * h0"]


@register(
    "dprime_limits",
    TABLES + f""", grid AS (SELECT f.*, x / 100 AS x, x / 100 * CASE WHEN x >= 0 THEN greatest(least(p * (1 - q), (1 - p) * q), 1e-10) ELSE greatest(least(p * q, (1 - p) * (1 - q)), 1e-10) END AS d FROM f, (SELECT unnest(range(-100, 101)) AS x)),
    h AS (SELECT *, {", ".join(f"greatest({e}, 1e-10) AS {n}" for n, e in _H.items())} FROM grid),
    l AS (SELECT i, j, x, {" + ".join(f"c{k} * ln(greatest({e}, 1e-10))" for k, e in enumerate(_CHANCE))} AS l FROM h),
    m AS (SELECT i, j, x, l >= max(l) OVER (PARTITION BY i, j) - 1.9207 AS inside FROM l)
    SELECT i, j, round(min(x) FILTER (inside), 4) AS low, round(max(x) FILTER (inside), 4) AS high FROM m GROUP BY 1, 2""",
)
def dprime_limits(spark: SparkSession, sf: str) -> DataFrame:
    return dprime.pair_dprime(tables(spark, sf)).select("i", "j", r("low", 4), r("high", 4))


_STEP = """list_reduce(list_prepend(p * q, list_transform(range(20), lambda k: 0::DOUBLE)), lambda b, k: least(greatest((2 * c8 + c7 + c5
  + c4 * b * greatest(1 - p - q + b, 1e-10) / greatest(b * greatest(1 - p - q + b, 1e-10) + greatest(p - b, 1e-10) * greatest(q - b, 1e-10), 1e-10)) / (2 * n), 1e-10), greatest(least(p, q), 1e-10)))"""


@register(
    "dprime_unphased",
    TABLES + f""", e AS (SELECT i, j, p, q, {_STEP} AS b FROM f),
    n AS (SELECT i, j, b, greatest(p - b, 1e-10) AS x, greatest(q - b, 1e-10) AS y, greatest(1 - p - q + b, 1e-10) AS z FROM e),
    s AS (SELECT i, j, b / (b + x + y + z) AS b, (b + x) / (b + x + y + z) AS p, (b + y) / (b + x + y + z) AS q FROM n),
    d AS (SELECT i, j, b - p * q AS d, CASE WHEN b - p * q >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END AS most FROM s)
    SELECT i, j, round(CASE WHEN most > 1e-12 THEN least(abs(d) / most, 1) ELSE 0 END, 4) AS dprime FROM d""",
)
def dprime_unphased(spark: SparkSession, sf: str) -> DataFrame:
    return dprime.pair_dprime(tables(spark, sf)).select("i", "j", r("dprime", 4))


#: The test variants are hardly linked, so these queries lower the methods' published limits until there are blocks.
BLOCKS = {
    "spine": {"threshold": 0.3011}, "gabriel": {"low": -1.1, "high": 0.3, "recombinant": 0.25}, "big_ld": {"threshold": 0.02}, "changepoint": {"penalty": 0.002}, "dp": {"frequent": 0.02},
    "aligned": {"most": 12}, "cc_graph": {"threshold": 0.05}, "graphical": {"penalty": 0.08, "window": 20, "overlap": 5},
}


def found_blocks(spark: SparkSession, sf: str, method: str) -> DataFrame:
    needs = blocks.NEEDS.get(method)
    own = with_dprime(spark, sf) if needs == "dprime" else pairs(spark, sf, PAIR_WINDOW)
    return blocks.detect(views.variants(spark, sf), own, method, views.geno(spark, sf) if needs == "calls" else None, **BLOCKS[method])


#: Variants by place k on their chromosome, and pairs by the places of both.
PLACED = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT v_idx, chr, pos, row_number() OVER (PARTITION BY chr ORDER BY pos, v_idx) - 1 AS k FROM variants),
  pr AS (SELECT a.chr, a.k AS a, b.k AS b, r * r AS r2, i, j FROM pairs JOIN v a ON a.v_idx = i JOIN v b ON b.v_idx = j) """
#: Blocks (chr, a, b) by place to the columns of `detect`.
TOLD = """, told AS (SELECT chr, row_number() OVER (PARTITION BY chr ORDER BY a) - 1 AS block, a, b FROM found),
  m AS (SELECT t.chr, t.a, t.b, avg(r2) AS mean_r2 FROM told t JOIN pr ON pr.chr = t.chr AND pr.a >= t.a AND pr.b <= t.b GROUP BY 1, 2, 3)
  SELECT t.chr, t.block, x.pos AS "start", y.pos AS "end", t.b - t.a + 1 AS n_variants, round(mean_r2, 6) AS mean_r2
  FROM told t JOIN v x ON x.chr = t.chr AND x.k = t.a JOIN v y ON y.chr = t.chr AND y.k = t.b LEFT JOIN m ON m.chr = t.chr AND m.a = t.a AND m.b = t.b"""


def _taken_in(order: str) -> str:
    """Of the intervals ``cand`` (chr, a, b, ...) those that overlap none taken before, in an order."""
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY {order}) AS n FROM cand),
    walk AS (SELECT chr, 0::BIGINT AS n, false AS ok, -1::BIGINT AS a, -1::BIGINT AS b, []::BIGINT[] AS taken FROM (SELECT DISTINCT chr FROM ranked)
      UNION ALL SELECT w.chr, r.n, NOT list_has_any(taken, range(r.a, r.b + 1)), r.a, r.b, CASE WHEN list_has_any(taken, range(r.a, r.b + 1)) THEN taken ELSE list_concat(taken, range(r.a, r.b + 1)) END
      FROM walk w JOIN ranked r ON r.chr = w.chr AND r.n = w.n + 1),
    found AS (SELECT chr, a, b FROM walk WHERE ok) """


_INNER = "FROM (SELECT x.chr, x.k AS a, y.k AS b FROM v x JOIN v y ON x.chr = y.chr AND y.k > x.k) s JOIN {pr} q ON q.chr = s.chr AND q.a >= s.a AND q.b <= s.b GROUP BY 1, 2, 3"
_BIG = PLACED + ", cand AS (SELECT s.chr, s.a, s.b, (s.b - s.a + 1) * sum(r2) / ((s.b - s.a) * (s.b - s.a + 1) / 2) AS w " + _INNER.format(pr="pr") + " HAVING sum(r2) / ((s.b - s.a) * (s.b - s.a + 1) / 2) >= 0.02)" + _taken_in("w DESC, a, b")
_LIMITS = f""", g AS (SELECT a.v_idx AS i, b.v_idx AS j, a.dosage::INT * 3 + b.dosage::INT AS k, count(*) AS n FROM c a JOIN c b ON a.chr = b.chr AND a.s_idx = b.s_idx AND b.pos > a.pos GROUP BY ALL),
  tab AS (SELECT i, j, sum(n) AS n, {", ".join(f"coalesce(sum(n) FILTER (k = {k}), 0) AS c{k}" for k in range(9))} FROM g GROUP BY 1, 2),
  f AS (SELECT *, least(greatest((2 * (c6 + c7 + c8) + c3 + c4 + c5) / (2 * n), 1e-10), 1 - 1e-10) AS p, least(greatest((2 * (c2 + c5 + c8) + c1 + c4 + c7) / (2 * n), 1e-10), 1 - 1e-10) AS q FROM tab) """
_GRID = f""", grid AS (SELECT f.*, x / 100 AS x, x / 100 * CASE WHEN x >= 0 THEN greatest(least(p * (1 - q), (1 - p) * q), 1e-10) ELSE greatest(least(p * q, (1 - p) * (1 - q)), 1e-10) END AS d FROM f, (SELECT unnest(range(-100, 101)) AS x)),
  h AS (SELECT *, {", ".join(f"greatest({e}, 1e-10) AS {n}" for n, e in _H.items())} FROM grid),
  l AS (SELECT i, j, x, {" + ".join(f"c{k} * ln(greatest({e}, 1e-10))" for k, e in enumerate(_CHANCE))} AS l FROM h),
  inside AS (SELECT i, j, x, l >= max(l) OVER (PARTITION BY i, j) - 1.9207 AS inside FROM l),
  ci AS (SELECT i, j, min(x) FILTER (inside) AS low, max(x) FILTER (inside) AS high FROM inside GROUP BY 1, 2),
  pc AS (SELECT pr.*, low > -1.1 AND high > 0.3 AS strong, high < 0.25 AS weak FROM pr JOIN ci USING (i, j)) """
_EM = f""", e AS (SELECT i, j, p, q, {_STEP} AS b FROM f), n AS (SELECT i, j, b, greatest(p - b, 1e-10) AS x, greatest(q - b, 1e-10) AS y, greatest(1 - p - q + b, 1e-10) AS z FROM e),
  s AS (SELECT i, j, b / (b + x + y + z) AS b, (b + x) / (b + x + y + z) AS p, (b + y) / (b + x + y + z) AS q FROM n),
  dp AS (SELECT pr.chr, pr.a, pr.b, abs(s.b - p * q) / CASE WHEN s.b - p * q >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END >= 0.3011 AS ok FROM s JOIN pr USING (i, j)) """
BLOCK_SQL = {
    "big_ld": _BIG + TOLD,
    "gabriel": PLACED + _LIMITS + _GRID + ", cand AS (SELECT s.chr, s.a, s.b " + _INNER.format(pr="pc") + " HAVING count(*) FILTER (strong OR weak) > 0 AND count(*) FILTER (strong) >= 0.95 * count(*) FILTER (strong OR weak) AND count(*) FILTER (weak) < 0.04 * count(*) FILTER (strong OR weak))"
    + _taken_in("b - a DESC, a DESC") + TOLD,
    "spine": PLACED + _LIMITS + _EM + """, bad AS (SELECT x.chr, x.k AS a, min(y.k) AS stop FROM v x JOIN v y ON x.chr = y.chr AND y.k > x.k
      WHERE EXISTS (SELECT 1 FROM v z LEFT JOIN dp ON dp.chr = z.chr AND dp.a = z.k AND dp.b = y.k WHERE z.chr = x.chr AND z.k >= x.k AND z.k < y.k AND NOT coalesce(dp.ok, false)) GROUP BY 1, 2),
      size AS (SELECT chr, max(k) + 1 AS m FROM v GROUP BY 1), run AS (SELECT v.chr, v.k AS a, coalesce(stop, m) - 1 AS b FROM v JOIN size USING (chr) LEFT JOIN bad ON bad.chr = v.chr AND bad.a = v.k),
      walk AS (SELECT chr, a, b FROM run WHERE a = 0 UNION ALL SELECT r.chr, r.a, r.b FROM walk w JOIN run r ON r.chr = w.chr AND r.a = w.b + 1),
      found AS (SELECT chr, a, b FROM walk WHERE b > a) """ + TOLD,
    "cc_graph": PLACED + """, e AS (SELECT chr, a, b FROM pr WHERE round(r2, 12) > 0.05 AND b - a <= 100 UNION SELECT chr, b, a FROM pr WHERE round(r2, 12) > 0.05 AND b - a <= 100),
      reach AS (SELECT chr, k AS a, k AS b FROM v UNION SELECT reach.chr, reach.a, e.b FROM reach JOIN e ON e.chr = reach.chr AND e.a = reach.b), comp AS (SELECT chr, a AS k, min(b) AS c FROM reach GROUP BY 1, 2),
      w AS (SELECT x.chr, x.c, avg(r2) AS mean_r2 FROM comp x JOIN pr ON pr.chr = x.chr AND pr.a = x.k JOIN comp y ON y.chr = x.chr AND y.k = pr.b AND y.c = x.c GROUP BY 1, 2),
      n AS (SELECT comp.chr, c, min(pos) AS s, max(pos) AS e, count(*) AS n FROM comp JOIN v USING (chr, k) GROUP BY 1, 2)
      SELECT n.chr, row_number() OVER (PARTITION BY n.chr ORDER BY n.c) - 1 AS block, s AS "start", e AS "end", n AS n_variants, round(mean_r2, 6) AS mean_r2 FROM n LEFT JOIN w ON w.chr = n.chr AND w.c = n.c""",
}


for _method in blocks.METHODS:
    register(f"blocks_{_method}", BLOCK_SQL.get(_method))(lambda spark, sf, method=_method: found_blocks(spark, sf, method).withColumn("mean_r2", F.round("mean_r2", 6)))


@register("blocks_compare")
def blocks_compare(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.compare_all({m: found_blocks(spark, sf, m) for m in ("spine", "big_ld", "cc_graph")})


@register(
    "blocks_summary",
    _BIG + """, f AS (SELECT f.b - f.a + 1 AS n, y.pos - x.pos + 1 AS bases FROM found f JOIN v x ON x.chr = f.chr AND x.k = f.a JOIN v y ON y.chr = f.chr AND y.k = f.b)
    SELECT count(*) AS n_blocks, sum(n)::BIGINT AS n_variants, round(avg(n), 6) AS mean_size, median(n)::DOUBLE AS median_size, round(avg(bases), 6) AS mean_bases, median(bases)::DOUBLE AS median_bases FROM f""",
)
def blocks_summary(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.summary(found_blocks(spark, sf, "big_ld")).withColumns({"mean_size": F.round("mean_size", 6), "mean_bases": F.round("mean_bases", 6)})


@register(
    "blocks_blockiness",
    TABLES + f""", e AS (SELECT i, j, p, q, {_STEP} AS b FROM f),
    n AS (SELECT i, j, b, greatest(p - b, 1e-10) AS x, greatest(q - b, 1e-10) AS y, greatest(1 - p - q + b, 1e-10) AS z FROM e),
    s AS (SELECT i, j, b / (b + x + y + z) AS b, (b + x) / (b + x + y + z) AS p, (b + y) / (b + x + y + z) AS q FROM n),
    d AS (SELECT i, j, round(abs(b - p * q) / CASE WHEN b - p * q >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END, 9) AS d FROM s),
    v AS (SELECT v_idx, chr, row_number() OVER (PARTITION BY chr ORDER BY pos, v_idx) AS k, count(*) OVER (PARTITION BY chr) AS m FROM variants),
    j AS (SELECT a.chr, a.m, d, r * r AS r2, b.k - a.k = 1 AS beside FROM pairs JOIN d USING (i, j) JOIN v a ON a.v_idx = i JOIN v b ON b.v_idx = j),
    h AS (SELECT chr, m, avg((d > 0.3011)::INT) AS q, least(avg(r2) FILTER (beside) / avg(r2), 1) AS a FROM j GROUP BY 1, 2)
    SELECT chr, m AS n_variants, round(q, 6) AS q, round(a, 6) AS q_adj, round(q * a, 6) AS blockiness FROM h""",
)
def blocks_blockiness(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.diagnose(views.variants(spark, sf), with_dprime(spark, sf), 0.3011).select("chr", "n_variants", r("q"), r("q_adj"), r("blockiness"))


@register("blocks_uncertain")
def blocks_uncertain(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators import encode

    from .core import probabilities

    return blocks.detect_uncertain(encode.dosage_moments(probabilities(spark, sf)), views.variants(spark, sf), pairs(spark, sf, PAIR_WINDOW), threshold=0.005, good=0.0)


@register("blocks_cross_population")
def blocks_cross_population(spark: SparkSession, sf: str) -> DataFrame:
    g, v = views.geno(spark, sf), views.variants(spark, sf)
    parts = [ld.pair_correlations(g.where(F.col("s_idx") % 2 == k), v, PAIR_WINDOW).withColumn("population", F.lit(str(k))) for k in range(2)]
    return blocks.detect_cross_population(v, parts[0].unionByName(parts[1]), ["0", "1"], hint=4, stable=0.2)


STUDY_P = cte("studies") + ", a AS (SELECT v_idx, snp, beta, se, n, exp(-power(beta / se, 2) / 2) AS p FROM studies) "


@register(
    "stouffer_combined",
    STUDY_P + f""", z AS (SELECT v_idx, sum(n * -{norm_ppf('p')}) / sqrt(sum(n * n)) AS z FROM a GROUP BY 1) SELECT v_idx, round(z, 6) AS z, round({norm_sf2('z')}, 6) AS p_stouffer FROM z""",
)
def stouffer_combined(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.stouffer(study_p(spark, sf), "v_idx", weight="n").select("v_idx", r("z"), r("p_stouffer"))


@register(
    "meta_sample_size",
    STUDY_P + f""", z AS (SELECT snp, sum(sqrt(n) * -{norm_ppf('p / 2')} * sign(beta)) / sqrt(sum(n)) AS z, sum(n)::BIGINT AS n FROM a GROUP BY 1)
    SELECT snp, round(z, 6) + 0::DOUBLE AS z, n, round({norm_sf2('z')}, 6) AS p FROM z""",
)
def meta_sample_size(spark: SparkSession, sf: str) -> DataFrame:
    p = F.exp(-F.pow(F.col("beta") / F.col("se"), 2) / 2)
    rows = evidence.meta_sample_size(views.studies(spark, sf).withColumn("p", p))
    return rows.select("snp", (F.round("z", 6) + F.lit(0.0)).alias("z"), "n", r("p"))


@register(
    "meta_han_eskin",
    cte("studies").replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT snp, beta AS b, se * se AS v FROM studies),
    t AS (SELECT snp, 0 AS k, 0::DOUBLE AS mu, 0::DOUBLE AS tau FROM s GROUP BY 1 UNION ALL
      SELECT snp, k + 1, max(mu), greatest(0, sum((1 / (v + tau)) ** 2 * ((b - mu) ** 2 - v)) / sum((1 / (v + tau)) ** 2)) FROM (SELECT t.snp, k, tau, b, v, sum(b / (v + tau)) OVER w / sum(1 / (v + tau)) OVER w AS mu FROM t JOIN s USING (snp) WHERE k < 100 WINDOW w AS (PARTITION BY t.snp, k)) GROUP BY 1, k),
    x AS (SELECT snp, greatest(sum(ln(v / (v + tau))) + sum(b * b / v) - sum((b - mu) ** 2 / (v + tau)), 0) AS stat FROM s JOIN (SELECT * FROM t WHERE k = 100) USING (snp) GROUP BY 1)
    SELECT snp, round(stat, 5) AS stat, round(0.5 * {chi2_sf('stat', '1::DOUBLE')} + 0.5 * exp(-stat / 2), 5) AS p FROM x""",
)
def meta_han_eskin(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.han_eskin(views.studies(spark, sf)).select("snp", r("stat", 5), r("p", 5))


_PHI = "exp(-({0}) * ({0}) / 2) / sqrt(2 * pi())"


@register(
    "winners_curse",
    cte("pvals") + f""", z AS (SELECT v_idx, beta, se, beta / se AS z, 1.959963984540054 AS c FROM pvals)
    SELECT v_idx, round(beta, 6) AS beta, round(CASE WHEN abs(z) >= c THEN beta - se * ({_PHI.format('c - z')} - {_PHI.format('-c - z')}) / ({norm_cdf('z - c')} + {norm_cdf('-z - c')}) ELSE beta END, 6) AS beta_corrected FROM z""",
)
def winners_curse(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.winners_curse(views.pvals(spark, sf)).select("v_idx", r("beta"), r("beta_corrected"))


@register(
    "fiqt",
    cte("pvals") + f""", z AS (SELECT v_idx, beta / se AS z, {norm_sf2('beta / se')} AS q FROM pvals), r AS (SELECT *, q * count(*) OVER () / row_number() OVER (ORDER BY q, v_idx) AS raw, row_number() OVER (ORDER BY q, v_idx) AS k FROM z),
    b AS (SELECT v_idx, z, least(min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM r)
    SELECT v_idx, round(CASE WHEN q >= 1 THEN 0 ELSE -{norm_ppf('(greatest(q / 2, 1e-300))')} * sign(z) END, 6) + 0::DOUBLE AS z_fiqt FROM b""",
)
def fiqt(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.fiqt(views.pvals(spark, sf), ["v_idx"]).select("v_idx", (F.round("z_fiqt", 6) + F.lit(0.0)).alias("z_fiqt"))


def _cluster(names: str) -> str:
    """One subset of the traits: its log evidence, size and candidate in each locus."""
    own = " + ".join(names.split(","))
    prior = f"ln(1e-4) + {names.count(',')} * ln(0.98) + {2 - names.count(',')} * ln(0.02)"
    return f"SELECT chr, '{names.upper()}' AS cluster, {names.count(',') + 1} AS size, {prior} AS prior, {prior} + max({own}) + ln(sum(exp({own} - m))) AS score, arg_max(v_idx, {own}) AS candidate FROM (SELECT *, max({own}) OVER (PARTITION BY chr) AS m FROM w) GROUP BY 1"


@register(
    "hyprcoloc",
    cte("studies") + """, l AS (SELECT chr, v_idx, study, 0.5 * ln(1 - 0.0225 / (0.0225 + se ** 2)) + 0.5 * 0.0225 / (0.0225 + se ** 2) * (beta / se) ** 2 AS l FROM studies),
    w AS (SELECT chr, v_idx, max(l) FILTER (study = 'A') AS a, max(l) FILTER (study = 'N') AS n, max(l) FILTER (study = 'R') AS r FROM l GROUP BY 1, 2 HAVING count(*) = 3),
    s AS (""" + " UNION ALL ".join(_cluster(c) for c in ("a,n", "a,r", "n,r", "a,n,r")) + """),
    t AS (SELECT *, max(score) OVER (PARTITION BY chr) AS top, ln(greatest(1 - sum(exp(prior)) OVER (PARTITION BY chr), 1e-300)) AS none FROM s),
    u AS (SELECT *, greatest(top, none) AS g FROM t), v AS (SELECT *, exp(none - g) + sum(exp(score - g)) OVER (PARTITION BY chr) AS total, row_number() OVER (PARTITION BY chr ORDER BY score DESC, size DESC) AS k FROM u)
    SELECT chr, cluster, round(exp(score - g) / total, 6) AS posterior, candidate FROM v WHERE k = 1""",
)
def hyprcoloc(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.hyprcoloc(views.studies(spark, sf).withColumnRenamed("study", "trait"), "chr", ["A", "N", "R"]).withColumn("posterior", F.round("posterior", 6))


@register("mr_presso")
def mr_presso(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.mr_presso(inst(spark, sf))


@register(
    "gene_set_enrichment",
    cte("pvals", "genes") + f""", g AS (SELECT gene, count(*) AS k, avg(abs(beta / se)) AS z FROM genes g JOIN pvals v ON g.chr = v.chr AND pos >= "start" - 2000 AND pos <= "end" + 2000 GROUP BY 1),
    a AS (SELECT gene, z - avg(z) OVER () AS z, k - avg(k) OVER () AS e, ln(k + 1) - avg(ln(k + 1)) OVER () AS l FROM g),
    b AS (SELECT gene, z - e * (sum(z * e) OVER ()) / (sum(e * e) OVER ()) AS z, e, l - e * (sum(l * e) OVER ()) / (sum(e * e) OVER ()) AS l FROM a),
    c AS (SELECT gene, z - l * (sum(z * l) OVER ()) / (sum(l * l) OVER ()) AS z, e, l, sum(e * e) OVER () AS ee, sum(l * l) OVER () AS ll, count(*) OVER () AS n FROM b),
    t AS (SELECT *, sum(z * z) OVER () AS zz FROM c),
    s AS (SELECT gene_set, count(*) AS m, sum(z) AS mz, count(*) - count(*) * count(*) / max(n) - power(sum(e), 2) / max(ee) - power(sum(l), 2) / max(ll) AS mm, max(n) AS n, max(zz) AS zz
      FROM (SELECT DISTINCT p_brand AS gene, p_type AS gene_set FROM part) JOIN t USING (gene) GROUP BY 1),
    x AS (SELECT gene_set, m, mm > 1e-9 AND m < n AS ok, mz / mm AS beta, mz / mm / sqrt((zz - mz * mz / mm) / (n - 4) / mm) AS t, n FROM s),
    p AS (SELECT *, {t_sf2('t', '(n - 4)::DOUBLE')} / 2 AS tail FROM x)
    SELECT gene_set, m AS n_genes, round(CASE WHEN ok THEN beta ELSE 0 END, 6) + 0::DOUBLE AS beta, round(CASE WHEN NOT ok THEN 1 WHEN t > 0 THEN tail ELSE 1 - tail END, 6) AS p FROM p""",
)
def gene_set_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    wide = views.genes(spark, sf).withColumns({"lo": F.col("start") - 2000, "hi": F.col("end") + 2000}).select("gene", "chr", "lo", "hi")
    hit = intervals.range_join(views.pvals(spark, sf).select("chr", "pos", "beta", "se"), wide, "lo", "hi", closed=True)
    genes = hit.groupBy("gene").agg(F.count("*").alias("k"), F.avg(F.abs(F.col("beta") / F.col("se"))).alias("z"))
    sets = views.read(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("gene_set"))
    return evidence.gene_set_enrichment(genes, sets).select("gene_set", "n_genes", (F.round("beta", 6) + F.lit(0.0)).alias("beta"), r("p"))


@register(
    "local_fdr",
    cte("pvals") + f""", z AS (SELECT v_idx, p, least(greatest(-{norm_ppf('(least(greatest(p, 1e-300), 1 - 1e-15))')}, -10), 10) AS z FROM pvals),
    k AS (SELECT *, least(floor((z + 10) / 0.01), 1999) AS k, (z + 10) / 0.01 AS place FROM z),
    w AS (SELECT g, sum(w) AS w FROM (SELECT k AS g, 1 - (place - k) AS w FROM k UNION ALL SELECT k + 1, place - k FROM k) GROUP BY 1),
    s AS (SELECT count(*) AS n, stddev_samp(z) * power(count(*), -0.2) AS h, least(greatest(count(*) FILTER (p > 0.5) / (count(*) * 0.5), 0.01), 1) AS pi0 FROM z),
    d AS (SELECT a.g, sum(w.w * exp(-0.5 * power((a.g - w.g) * 0.01 / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS f FROM (SELECT DISTINCT g FROM w) a, w, s GROUP BY 1)
    SELECT v_idx, round(p, 6) AS p, round(least(greatest(pi0 * exp(-z * z / 2) / sqrt(2 * pi()) / greatest(a.f + (b.f - a.f) * (place - k), 1e-20), 0), 1), 5) AS local_fdr FROM k JOIN d a ON a.g = k JOIN d b ON b.g = k + 1, s""",
)
def local_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.local_fdr(views.pvals(spark, sf)).select("v_idx", r("p"), r("local_fdr", 5))


@register("ihw")
def ihw(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.ihw(views.pvals(spark, sf), "n", ["v_idx"]).select("v_idx", "p", "weight", "p_adj")


@register(
    "impute_ld",
    CELLS + """, f AS (SELECT v_idx, s_idx, dosage, coalesce(dosage, avg(dosage) OVER (PARTITION BY v_idx)) AS g FROM cells),
    w AS (SELECT a.v_idx AS i, b.v_idx AS j, abs(corr(a.g, b.g)) AS w FROM f a JOIN f b ON a.s_idx = b.s_idx AND a.v_idx <> b.v_idx AND abs(a.v_idx - b.v_idx) <= 50 GROUP BY 1, 2 HAVING var_pop(a.g) > 0 AND var_pop(b.g) > 0),
    x AS (SELECT m.v_idx, m.s_idx, sum(w * o.g) / sum(w) AS guess, sum(w) AS total FROM f m JOIN w ON w.i = m.v_idx JOIN f o ON o.v_idx = w.j AND o.s_idx = m.s_idx WHERE m.dosage IS NULL GROUP BY 1, 2)
    SELECT v_idx, s_idx, round(coalesce(dosage, CASE WHEN total > 1e-10 THEN guess END, g), 6) AS dosage FROM f LEFT JOIN x USING (v_idx, s_idx)""",
)
def impute_ld(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.impute_from_neighbours(cells(spark, sf)).withColumn("dosage", F.round("dosage", 6))


@register("required_n", cte("pvals", "geno") + """, f AS (SELECT v_idx, avg(dosage) / 2 AS af FROM geno GROUP BY 1)
  SELECT v_idx, round((1.959963984540054 + 0.8416212335729143) ** 2 / (2 * af * (1 - af) * beta * beta), 4) AS required_n FROM pvals JOIN f USING (v_idx) WHERE abs(beta) > 0.05""")
def required_n(spark: SparkSession, sf: str) -> DataFrame:
    from lociframe.operators import qc

    rows = views.pvals(spark, sf).join(qc.allele_frequency(views.geno(spark, sf)), "v_idx").where("abs(beta) > 0.05")
    need = (1.959963984540054 + 0.8416212335729143) ** 2 / (2 * F.col("af") * (1 - F.col("af")) * F.col("beta") * F.col("beta"))
    return rows.select("v_idx", F.round(need, 4).alias("required_n"))


@register("locus_summary", cte("pvals") + """SELECT chr, count(*) AS n, round(max(abs(beta / se)), 6) AS top_z, arg_min(v_idx, p) AS lead FROM pvals GROUP BY 1""")
def locus_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pvals(spark, sf)
    return rows.groupBy("chr").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("beta") / F.col("se"))), 6).alias("top_z"), F.min_by("v_idx", F.struct("p", "v_idx")).alias("lead"))


@register(
    "smr_top_genes",
    EQTL + """, k AS (SELECT gene, snp, bx, sx, ey, sy, ey / bx AS ratio, (sy / bx) ** 2 + (ey * sx / bx ** 2) ** 2 AS var, row_number() OVER (PARTITION BY gene ORDER BY abs(bx / sx) DESC, snp) AS k FROM e WHERE bx <> 0),
    h AS (SELECT gene, count(*) AS n, sum((a.ratio - b.ratio) ** 2 / (a.var + b.var)) AS heidi FROM k a JOIN (SELECT * FROM k WHERE k = 1) b USING (gene) WHERE a.k BETWEEN 2 AND 21 GROUP BY 1)
    SELECT gene, snp, round(ratio, 6) AS beta_smr, round((bx / sx) ** 2 * (ey / sy) ** 2 / ((bx / sx) ** 2 + (ey / sy) ** 2), 6) AS chi2, n, round(heidi, 6) AS heidi FROM k LEFT JOIN h USING (gene) WHERE k = 1""",
)
def smr_top_genes(spark: SparkSession, sf: str) -> DataFrame:
    """SMR and HEIDI of each gene side by side, genes HEIDI could not test included."""
    rows = eqtl(spark, sf)
    both = sumstats.smr(rows).join(sumstats.heidi(rows, most=20), "gene", "left")
    return both.select("gene", "snp", r("beta_smr"), r("chi2"), "n", r("heidi"))


@register("effective_tests")
def effective_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Effective number of tests of each chromosome from its correlation spectrum."""
    import pandas as pd

    from lociframe.operators import bayes, kinship

    work = lambda rows, r: pd.DataFrame({"block": rows["block"].iloc[:1], "n": [len(rows)], "n_effective": [kinship.effective_tests(r)]})
    return bayes.by_block(chromosome_stats(spark, sf), pairs(spark, sf, PAIR_WINDOW), work, "block string, n long, n_effective long")
