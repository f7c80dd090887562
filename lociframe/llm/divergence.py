"""Source divergence audit: how the words of a language's sources differ, by DuckDB over shards of terms.

Each language keeps the terms of at least LEAST_DOCS of its documents. A source has, for each kept
term, the smoothed share p in whole billionths; two sources differ by the chi-square-like sum of
floor((p - q)^2 / q) over all kept terms, and the terms that a source has above its language's share
are ranked by it. All arithmetic is in whole numbers.

1. Tasks count terms of their own documents and flush the counts; rows are dealt into shards by
   (language, term), so that a term has one shard. In each shard DuckDB adds the counts up and keeps
   the frequent terms.
2. Spark adds up each source's total, each language's number of terms, and how many terms of a source
   have each count.
3. The shards get those totals with their rows. DuckDB adds up, for pairs of sources that both have a
   term, what that term changes against both having it not, and picks each source's best terms.
4. Spark adds to these the terms that one source has (from the numbers of terms by count) or none
   has (in one product), and ranks.

Scale: counts are combined before the only shuffles; nothing is broadcast by hint. The number of
shards grows with the rows (SHARD_ROWS), whichever language or source holds most of them, and a shard
adds up while it reads. A term costs the square of the sources that have it, not of all.

Defined results: null text, lang and source are ''; a group without kept terms is compared like any
other; a language without kept terms has value 0 for all its pairs; repeated rows count one by one;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import discard, written

LEAST_DOCS = 3
BEST_TERMS = 200
SCALE = 1_000_000_000
#: Rows of counts that a task holds before it passes them on.
HELD = 200_000
#: Rows of counts in a shard, about.
SHARD_ROWS = 1 << 20
SLICE_BYTES = 1 << 20
#: What belongs to a term: letters of A-Z in either case (lower-cased) and all bytes of other characters.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within a task as far as HELD allows."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in own.items():
                size = len(n)
                named = [pa.array([x], pa.string()).take(pa.array([0] * size, pa.int32())) for x in (lang, source)]
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*named, terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            own.clear()

        for batch in stream:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for a, _, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                for k, text in enumerate(texts, a):
                    terms = (text or "").encode().translate(_TERM).split()
                    n, docs = own.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in own.values()) > HELD:
                    yield from told()
        yield from told()

    return docs.select("lang", "source", "text").mapInArrow(bytescan.tidy(count), _COUNTS)


def _session() -> duckdb.DuckDBPyConnection:
    """One thread and bounded memory; nothing goes to a local disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "lang", "term")


def kept_terms(counts: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n) of the terms in at least LEAST_DOCS documents of their language."""

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _session() as sql:
            sql.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            held, limit = 0, SHARD_ROWS
            for batch in stream:
                sql.register("batch", pa.table(batch))
                sql.execute("INSERT INTO counts SELECT lang, source, term, sum(n), sum(docs) FROM batch GROUP BY ALL")
                sql.unregister("batch")
                held += batch.num_rows
                if held > limit:
                    sql.execute("CREATE OR REPLACE TABLE counts AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL")
                    held = sql.sql("SELECT count(*) FROM counts").fetchall()[0][0]
                    limit = max(SHARD_ROWS, 2 * held)
            kept = sql.sql(f"""
                SELECT lang, source, term, sum(n)::BIGINT AS n FROM counts
                SEMI JOIN (SELECT lang, term FROM counts GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}) USING (lang, term) GROUP BY ALL
            """).to_arrow_table()
            yield from kept.to_batches(max_chunksize=1 << 16)

    return _sharded(counts, shards).mapInArrow(bytescan.tidy(add), "lang string, source string, term string, n bigint")


_SHARD_SQL = f"""
WITH shares AS (
  SELECT lang, source, term, n, whole, terms,
    (1 + {SCALE}::HUGEINT * (n + 1) // (size + terms))::BIGINT AS p, (1 + {SCALE}::HUGEINT // (size + terms))::BIGINT AS none
  FROM rows),
both_have AS (
  SELECT a.lang, a.source, b.source AS item,
    sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.none) * (a.p - b.none) // b.none
      - (a.none - b.p) * (a.none - b.p) // b.p + (a.none - b.none) * (a.none - b.none) // b.none)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
langs AS (
  SELECT lang, term, (1 + {SCALE}::HUGEINT * (sum(n) + 1) // (any_value(whole) + any_value(terms)))::BIGINT AS q FROM rows GROUP BY ALL),
above AS (
  SELECT s.lang, source, s.term AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN langs l ON s.lang = l.lang AND s.term = l.term WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY s.lang, source ORDER BY value DESC, s.term) <= {BEST_TERMS})
SELECT lang, source, 'pair' AS part, item, value FROM both_have
UNION ALL SELECT lang, source, 'term', item, value FROM above
"""


def shard_sums(rows: DataFrame, shards: int) -> DataFrame:
    """(lang, source, part, item, value) by shard: partial sums of pairs, and the best terms.

    ``rows`` (lang, source, term, n, size, terms, whole) has the totals with each count.
    """

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _session() as sql:
            sql.execute("CREATE TABLE rows (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, size BIGINT, terms BIGINT, whole BIGINT)")
            for batch in stream:
                sql.register("batch", pa.table(batch))
                sql.execute("INSERT INTO rows SELECT lang, source, term, n, size, terms, whole FROM batch")
                sql.unregister("batch")
            yield from sql.sql(_SHARD_SQL).to_arrow_table().to_batches(max_chunksize=1 << 16)

    own = _sharded(rows.select("lang", "source", "term", "n", "size", "terms", "whole"), shards)
    return own.mapInArrow(bytescan.tidy(add), "lang string, source string, part string, item string, value bigint")


def _share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + terms)); 1 where there are no terms."""
    above = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.coalesce(F.call_function("div", above, F.nullif((size + terms).cast("decimal(19,0)"), F.lit(0))), F.lit(0)).cast("long") + 1


def _term(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source its other sources by difference, and its own terms."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    groups = named.select("lang", "source").distinct()
    counts = written(term_counts(named), "divergence-counts")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD_ROWS))
    kept = written(kept_terms(counts, shards), "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "whole"])
    sizes = sizes.withColumn("none", _share(F.lit(0), F.col("size"), F.col("terms")))
    sizes = written(sizes, "divergence-groups")
    sums = written(shard_sums(kept.join(sizes, ["lang", "source"]), shards), "divergence-sums")

    others = sizes.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    wide = lambda c: c.cast("decimal(38,0)")
    plain = sizes.join(others, "lang").where("source != item")
    plain = plain.select("lang", "source", "item", wide(F.col("terms") * wide(_term(F.col("none"), F.col("other_none")))).alias("value"))
    by_count = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(sizes, ["lang", "source"])
    by_count = by_count.withColumn("p", _share(F.col("n"), F.col("size"), F.col("terms"))).join(others, "lang").where("source != item")
    p, none, other = F.col("p"), F.col("none"), F.col("other_none")
    ahead = by_count.select("lang", "source", "item", wide(F.col("k") * wide(_term(p, other) - _term(none, other))).alias("value"))
    back = by_count.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(F.col("k") * wide(_term(other, p) - _term(other, none))).alias("value"))
    both = sums.where("part = 'pair'").select("lang", "source", "item", wide(F.col("value")).alias("value"))
    pairs = plain.unionByName(ahead).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    best = sums.where("part = 'term'")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    done = ranked.unionByName(best.withColumn("rank", place).where(F.col("rank") <= BEST_TERMS))
    discard(counts)
    return done
