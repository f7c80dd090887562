"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Rows are numbered and written. Each text becomes its set of hashed shingles, a signature and band
   hashes. Texts with equal sets form one class by a fingerprint of the set; only classes go on.
2. Classes that share a band hash are a bucket. A bucket's most central class (the one in the
   fullest buckets) is its pivot; every other member is tested against the pivot. That is linear
   in the bucket, and in a group of near copies it links nearly all of them.
3. Components of the verified links. A bucket whose members, the pivot aside, lie in one component
   is settled. The others are split by size, since sets of similarity 0.8 differ by a quarter at
   most, and members of different components are compared in blocks: bitmaps give an upper bound of
   the intersection, and pairs that the bound can't exclude are verified. So no candidate pair is
   given up and no pair inside a component is emitted.
4. Components of all verified links. Verification always compares the full sets.

BANDS bands of ROWS slots miss a pair of similarity 0.8 with probability (1 - 0.8**ROWS)**BANDS,
about 5 in a million, and a component only if all its links there are missed.

Shingles have WIDTH words and similarity counts from 0.8 on.

Scale: signatures are made where the text is read; bands shuffle one small row each. Texts of
candidates are written once, and bitmaps made for unsettled members only. Verification groups are (pivot, part) with PART_ROWS members
at most, streamed in sorted order; only one pivot's set is held. Components contract in Spark.

Defined results: a null text or one without words has an empty set, is linked with nothing and is
its own component; rows that repeat a text are one class; rows are linked by their number, so rows
that repeat a key may differ in text; a component's name is its smallest key that is not null, and
null where all keys are; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, shingles
from .common import discard, written
from .components import components

WIDTH = 5
BANDS = 40
ROWS = 6
PART_ROWS = 64
BLOCK_ROWS = 256
SLICE_BYTES = 1 << 19
#: Bytes of bitmaps that are compared at once: those of long texts are large.
STEP_BYTES = 1 << 23
#: Ratio of the sizes in one size class: above 1 / 0.8, so similar sets are at most one class apart.
STEP = 1.26


def features(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``rows`` (id, key, text): id, key, n (size of the set), f1 and f2 (fingerprint of the set), bands."""
    kind = rows.schema["key"].dataType.simpleString()

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                sets = shingles.shingle_sets(texts, width)
                bands = shingles.band_hashes(shingles.super_minhash(sets, BANDS * ROWS), BANDS).view(np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([bytescan.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                columns = [
                    batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2),
                    pa.array([x if len(s) else [] for x, s in zip(bands, sets, strict=True)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "f1", "f2", "bands"])

    return rows.select("id", "key", "text").mapInArrow(bytescan.tidy(scan), f"id bigint, key {kind}, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def bitmaps(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, bits) of ``texts`` (id, text)."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                bits = [shingles.bitmap(s) for s in shingles.shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(bits, pa.binary())], ["id", "bits"])

    return texts.select("id", "text").mapInArrow(bytescan.tidy(scan), "id bigint, bits binary")


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more; texts is (id, text).

    Pairs are grouped by their first member, in parts of about PART_ROWS, so that its text moves
    once for each part; the sorted groups are streamed and one set is held at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).withColumnRenamed("a", "of")
    rows = pairs.join(parts, F.col("a") == F.col("of")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("member"), F.lit(1).alias("role"))
    rows = written(rows, "verify-rows")
    heads = rows.select("a", "part").distinct().select("a", "part", F.col("a").alias("member"), F.lit(0).alias("role"))
    rows = rows.unionByName(heads).join(texts, F.col("member") == F.col("id")).select("a", "part", "role", "member", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in stream:
            groups, roles = batch.column("a").to_pylist(), batch.column("role").to_pylist()
            linked = []
            for a, _, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                for k, other in enumerate(shingles.shingle_sets(texts, width), a):
                    if roles[k] == 0:
                        head, own = groups[k], other
                    elif head == groups[k]:
                        shared = len(np.intersect1d(own, other, assume_unique=True))
                        if shared and 100 * shared >= 80 * (len(own) + len(other) - shared):
                            linked.append(k)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("member").take(at)], ["a", "b"])

    return rows.mapInArrow(bytescan.tidy(compare), "a bigint, b bigint")


def sorted_groups(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` on each group, streamed from sorted partitions: little cost for a small group."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in stream:
            batch = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            new = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)) + 1
            bounds = [0, *new.tolist()]
            done = [out for a, b in zip(bounds, bounds[1:]) if (out := work(batch.iloc[a:b])) is not None]
            if done:
                yield pd.concat(done)
            rest = batch.iloc[bounds[-1] :]
        if rest is not None and len(rest) and (out := work(rest)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _plausible(group: pd.DataFrame) -> pd.DataFrame | None:
    """Pairs of two blocks in different components that the bitmaps can't exclude."""
    low = group["side"].to_numpy() == group["low"].to_numpy()
    same = group["low"].iloc[0] == group["high"].iloc[0]
    left, right = (group, group) if same else (group[low], group[~low])
    n, m = left["n"].to_numpy(np.int64)[:, None], right["n"].to_numpy(np.int64)[None]
    ids, others = left["rep"].to_numpy(), right["rep"].to_numpy()
    open_ = (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None]) & (10 * np.minimum(n, m) >= 8 * np.maximum(n, m))
    open_ &= ~(left["upper"].to_numpy()[:, None] & right["upper"].to_numpy()[None])
    if same:
        open_ &= ids[:, None] < others[None]
    rows, columns = np.nonzero(open_)
    if not len(rows):
        return None
    size = np.minimum(left["bits"].map(len).to_numpy()[rows], right["bits"].map(len).to_numpy()[columns])
    keep = []
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        fold = lambda frame, used: np.stack([shingles.folded(x, s) for x in frame["bits"].to_numpy()[used]])
        used, r = np.unique(rows[at], return_inverse=True)
        x = fold(left, used)
        used, c = np.unique(columns[at], return_inverse=True)
        y = fold(right, used)
        step = max(1, STEP_BYTES // s)
        for k in range(0, len(at), step):
            p, q, some = x[r[k : k + step]], y[c[k : k + step]], at[k : k + step]
            a, b = n[rows[some], 0], m[0, columns[some]]
            most = np.minimum(a - np.bitwise_count(p & ~q).sum(axis=1).astype(np.int64), b - np.bitwise_count(q & ~p).sum(axis=1).astype(np.int64))
            keep.append(some[9 * most >= 4 * (a + b)])
    keep = np.concatenate(keep)
    if not len(keep):
        return None
    a, b = ids[rows[keep]], others[columns[keep]]
    return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)})


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return written(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(text).alias("text")), "numbered-texts")


def _unsettled(open_: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs of members of one bucket in different components that could be similar; open_ is (bucket, rep, n, comp).

    A member of size class c (sizes within a factor of STEP) meets the others of c, and those of c + 1.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int")
    dealt = open_.withColumn("c", size).withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("g", F.col("c") - F.col("upper").cast("int"))
    groups = dealt.groupBy("bucket", "g").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("k"), F.count_if(~F.col("upper")).alias("own")).where("c1 != c2 and own > 0")
    groups = groups.select("bucket", "g", F.ceil(F.col("k") / BLOCK_ROWS).cast("int").alias("blocks"))
    rest = written(dealt.join(groups, ["bucket", "g"]), "unsettled-members")
    wanted = texts.join(rest.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")
    bits = bitmaps(wanted, width).withColumnRenamed("id", "rep")
    rest = rest.join(bits, "rep").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", "g", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "n", "comp", "upper", "bits")
    return sorted_groups(rest, ["bucket", "g", "low", "high"], _plausible, "a bigint, b bigint").distinct()


def labelled(numbered: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``numbered`` (id, key, text), written: id, key, n, component (its smallest key) and first (the id of its first row by key)."""
    found = written(features(numbered, width), "shingle-features")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id")).alias("first")
    classes = written(found.where("n > 0").groupBy("n", "f1", "f2").agg(first, F.first("bands").alias("bands")).withColumn("rep", F.col("first.id")), "shingle-classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = written(rows.join(full, "bucket"), "bucket-members")
    central = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "rep").groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", F.xxhash64("rep"), "rep")).alias("p"))
    stars = members.join(pivots, "bucket").select("bucket", "rep", "n", "size", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")).where("rep != pivot")
    members, every = written(stars, "bucket-stars"), members
    discard(every)
    stars = members.where(10 * F.least("n", "pivot_n") >= 8 * F.greatest("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    candidates = members.select(F.col("rep").alias("c")).union(members.select("pivot")).distinct()
    texts = written(numbered.select("id", "text").join(candidates, F.col("id") == F.col("c"), "left_semi"), "candidate-texts")
    links = written(verified(stars, texts, width), "star-links")
    labels = components(links)

    member_labels = labels.withColumnRenamed("node", "rep")
    open_ = members.where(F.col("size") > 2).join(member_labels, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    open_ = written(open_.select("bucket", "rep", "n", "comp"), "open-members")
    more = written(verified(written(_unsettled(open_, texts, width), "plausible-pairs"), texts, width), "more-links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(members, open_, texts, links, more)
    reps = classes.select("n", "f1", "f2", "first", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # written, so that the join back is one whose hot component can be split
    firsts = written(reps.groupBy("component").agg(F.min("first").alias("of_all")), "component-firsts")
    reps = reps.join(firsts, "component").select("n", "f1", "f2", "of_all")
    rows = found.select("id", "key", "n", "f1", "f2").join(reps, ["n", "f1", "f2"], "left")
    linked = F.col("n") > 0
    return rows.select("id", "key", "n", F.when(linked, F.col("of_all.key")).otherwise(F.col("key")).alias("component"), F.when(linked, F.col("of_all.id")).otherwise(F.col("id")).alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component (smallest key reachable over links)."""
    return labelled(_numbered(docs, key, text), width).select("key", F.col("n").alias("n_shingles"), "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, a null key being last. Rows without words all stay."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    kept = labelled(rows.select(F.col("__row").alias("id"), F.col(key).alias("key"), F.col(text).alias("text")), width).where("id = first").select(F.col("id").alias("__kept"))
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
