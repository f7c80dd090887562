"""Quality rules: per-text counts and cross-document line frequency (DataFrame functions only).

A line that many different documents of one host hold is boilerplate. Lines are normalised
(lower case, single spaces, trimmed) and hashed. `frequent_lines` counts both the documents and the
distinct texts of a host that hold a line; the distinct texts decide, so exact copies of one
document, which deduplication will remove, do not condemn its lines. Lines above the limits are
removed; a document that keeps too few of its words is depleted and rejected.

Scale: texts never shuffle, only line hashes do. Counts are partially aggregated before the
shuffle, and the join that brings the frequent lines back is a plain equi-join, so AQE picks
broadcast by measured size or splits the partition of a hot line. A line above the limit is in
a fixed share of its host's documents, or in MANY_DOCS of them, so the lines above it are a fixed
share of all lines at most.

Defined results: a null or empty text has no words and fails the base rule; null hosts form
one host of their own; each row is judged on its own text, so rows that repeat a key with one text
get one verdict and with other texts their own; a null key is a key like any other; an empty table
gives an empty result. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of, written

#: Lines in more than MIN_DOCS distinct texts of a host are boilerplate if these are more than
#: MAX_SHARE of the host's texts, or more than MANY_DOCS whatever the host's size.
MIN_DOCS = 20
MAX_SHARE = 0.02
MANY_DOCS = 5000
#: A document is depleted with fewer words left than this number or this share of its words.
LEFT_WORDS = 5
LEFT_SHARE = 0.2
WINDOW = 5


def _normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def text_counts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per document: base counts, hash of the text and [(line hash, words in the line)]."""
    value = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), value.alias("text"))
    split = base.select(
        "key", "host", F.xxhash64("text").alias("text_hash"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    hashed = split.select(
        "key", "host", "text_hash", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(_normalised(x)).alias("line"), F.size(words_of(x)).alias("n"))).alias("lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(F.slice("w", F.lit(1), F.size("w") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get("w", i + k) for k in range(1, WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    sorted_ = hashed.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("h")
    twice = sorted_.withColumn(
        "p",
        F.array_sort(
            F.transform(
                F.filter("s", lambda x, i: (F.get("s", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("s", F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))),
                lambda x: x["i"],
            )
        ),
    ).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(p - a["last"], F.lit(WINDOW))).alias("total")),
        lambda a: a["total"],
    )
    return twice.withColumn("n_repeat_words", covered).drop("p")


def frequent_lines(counts: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, line, n_texts, n_docs): lines above the limits, with the distinct texts (which decide) and the documents that hold them."""
    texts = counts.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    texts = texts.select("host", "copies", F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("lines"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_host"))
    lines = texts.select("host", "copies", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_docs"))
    lines = lines.where(F.col("n_texts") > min_docs).alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return lines.where((F.col("n_texts") > max_share * F.col("n_host")) | (F.col("n_texts") > many_docs)).select("l.host", "line", "n_texts", "n_docs")


def _host_line(host: Column, line: Column) -> Column:
    """One hash for a line of a host."""
    return F.xxhash64(host, line)


def _judged(docs: DataFrame, key: str, text: str, host: str, min_docs: int, max_share: float, left_words: int, left_share: float, many_docs: int) -> DataFrame:
    """The rows of `quality_rules` with text_hash and gone, the hashes of the row's lines above the limits (null for none)."""
    counts = written(text_counts(docs, key, text, host).withColumn("row", F.monotonically_increasing_id()), "quality-counts")
    frequent = frequent_lines(counts, min_docs, max_share, many_docs)
    lines = counts.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    hit = lines.alias("d").join(frequent.alias("f"), (F.col("d.line") == F.col("f.line")) & F.col("d.host").eqNullSafe(F.col("f.host")))
    gone = F.collect_set(_host_line(F.col("d.host"), F.col("d.line"))).alias("gone")
    removed = hit.groupBy(F.col("d.row").alias("hit_row")).agg(F.sum("n").alias("removed"), gone)
    rows = counts.drop("lines").join(removed, F.col("row") == F.col("hit_row"), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    depleted = F.col("removed").isNotNull() & ((left < left_words) | (left < left_share * F.col("n_words")))
    rows = rows.select(
        "key", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed_words"), depleted.alias("depleted"), "gone",
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE, many_docs: int = MANY_DOCS,
) -> DataFrame:
    """Per row of ``docs``: key, host, base counts, base_failed, removed_words, depleted, kept."""
    return _judged(docs, key, text, host, min_docs, max_share, left_words, left_share, many_docs).drop("gone", "text_hash")


def keep_good(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE, many_docs: int = MANY_DOCS,
) -> DataFrame:
    """``docs`` without the rows that the rules reject, each text without its lines above the limits; the other columns are untouched.

    A verdict follows from host and text, so rows meet theirs by key, host and hash of the text:
    rows that repeat one key with different texts keep their own verdicts.
    """
    own = ["__kept_key", "__kept_host", "__kept_hash"]
    rows = _judged(docs, key, text, host, min_docs, max_share, left_words, left_share, many_docs).where("kept")
    kept = rows.groupBy(F.col("key").alias(own[0]), F.col("host").alias(own[1]), F.col("text_hash").alias(own[2])).agg(F.first("gone").alias("__gone"))
    stays = lambda line: ~F.array_contains("__gone", _host_line(F.col(host), F.xxhash64(_normalised(line))))
    cleaned = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    same = F.col(key).eqNullSafe(F.col(own[0])) & F.col(host).eqNullSafe(F.col(own[1])) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(own[2]))
    return docs.join(kept, same).withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cleaned)).drop(*own, "__gone")
