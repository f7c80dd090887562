"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, hard_negatives, html_text, mixing, near_dedup, packing, pii, quality_model, quality_rules, sharding, simhash, token_counts, topk
from .common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("key", "doc_id").drop("host", "removed_words", "depleted")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM rep, range(5) r(k)) GROUP BY 1),
base AS (
  SELECT w.doc_id, source, t, l, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
lines AS (SELECT doc_id, source, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, t, unnest(l) AS x FROM base)),
hosts AS (SELECT source, count(DISTINCT t) AS n_host FROM base GROUP BY 1),
freq AS (SELECT f.source, line FROM (SELECT source, line, count(DISTINCT t) AS n_docs FROM lines GROUP BY 1, 2) f
  JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n_docs > 20 AND (n_docs > 0.02 * n_host OR n_docs > 5000)),
gone AS (SELECT doc_id, sum(n)::BIGINT AS removed FROM lines JOIN freq ON lines.line = freq.line AND lines.source IS NOT DISTINCT FROM freq.source GROUP BY 1),
verdict AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  removed IS NOT NULL AND (n_words - removed < 5 OR n_words - removed < 0.2 * n_words) AS depleted
  FROM base LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM verdict
"""


#: All pairs with a common shingle by an inverted index, their similarity on whole sets, and what each text reaches.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
same AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS f FROM s GROUP BY 1),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS rep FROM same),
r AS (SELECT s.* FROM s JOIN (SELECT DISTINCT rep FROM rep) ON rep = doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.sh = b.sh AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM rep UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN comp ON comp.a = rep.rep
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS c FROM embeddings),
d AS (SELECT q.vec_id AS query_id, o.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.c[i] <> o.c[i])::INT))::BIGINT AS distance FROM v q JOIN v o ON q.vec_id % 50 = 0 AND o.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]

    def joined(names: list[str]):
        told = [F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for name in names]
        return F.array_join(F.concat(*told), ",")

    scores = F.concat(*(F.transform(k.name, lambda s: F.format_string("%.1f", s["score"])) for k in pii.KINDS))
    return found.select(
        F.col("key").alias("doc_id"), *(F.size(name).cast("long").alias(f"n_{name}") for name in base),
        F.sha2(joined(base), 256).alias("base_sha256"), joined([k.name for k in pii.KINDS]).alias("spans"), F.array_join(scores, ",").alias("scores"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), 40)
    return rows.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def tokenizer_file() -> str:
    """The vocabulary that the registered queries use; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return rows.withColumnsRenamed({"key": "doc_id", "crc": "ids_crc32"})


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), 50256).withColumnRenamed("key", "doc_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.sign_codes(table(spark, sf_dir, "embeddings"))
    return topk.top_k(codes, F.col("id") % 50 == 0, 10).withColumnRenamed("id", "vec_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return rows.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda key: F.crc32(F.col(key).cast("string").cast("binary")) % 5
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id") != 0))
    rows = quality_model.score(docs, model)
    return rows.select(F.col("key").alias("doc_id"), (fold("key") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives.hard_negatives(hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id AS id, list_dot_product(a.v, o.v)::BIGINT AS score FROM e a JOIN e o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
n AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s))::BIGINT AS p FROM n WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) WINDOW s AS (PARTITION BY lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(v, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // y.p) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z ON z.lang = a.lang AND s = a.source AND o = b.source),
term AS (SELECT p.lang, source, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term QUALIFY rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_html_text": op2_html_text,
        "op3_mixing": op3_mixing,
        "op4_near_dedup": op4_near_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_pii": op6_pii,
        "op7_quality_model": op7_quality_model,
        "op8_token_counts": op8_token_counts,
        "op9_topk": op9_topk,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_simhash": op12_simhash,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op9_topk": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
