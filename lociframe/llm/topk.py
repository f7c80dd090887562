"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code is cut into s segments. If a code differs from the query in at most s * (r + 1) - 1 bits,
one of the segments differs in at most r. So the segment tables are probed at radius 0, 1, ...;
candidates are verified on whole codes; a query is done once its kth distance is at most
s * (r + 1) - 1, since nothing nearer, and no tie, can be left. One index serves all queries, and
one bound for each query holds for the whole index: done queries send no more probes, and a
candidate beyond the kth distance known so far is not passed on.

Scale: the index has a row for each (segment, value); the leading bits of a value are its part, so
a part holds about PART_CODES rows. In round r a query goes only to parts whose leading bits differ
from its own in r bits at most; there it probes the values that differ in r bits exactly. A part
that holds more rows (a common value) is dealt into chunks of PART_CODES by hash, and the queries
of a chunk are dealt into splits of SPLIT_QUERIES, so no group grows with the data; the groups are
streamed, with one chunk and one batch of queries held. A chunk passes on k rows for each query at
most. Each round is written, so a lost executor costs one round. Of rows with one code, the k + 1
of smallest id are enough; that limit is pushed below the shuffle, so a code that a third of the
rows share moves a few rows per task.

Defined results: neighbours are ordered by distance, then id; the query's own row is left out; a
null vector, a null or NaN element and a missing element of a shorter vector count as bit 0; null
ids are no queries and no neighbours; with fewer than k other rows all are returned; repeated ids
count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import discard, written

PART_CODES = 8192
SPLIT_QUERIES = 16_384
#: Pairs of a query and a mask, and candidates, that are looked at together.
STEP = 1 << 20


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): one bit for each dimension, set where the element is above 0, in bytes."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    width = (rows.agg(F.max(F.size("v"))).first()[0] or 1) if vectors.columns else 1
    width = math.ceil(max(1, width) / 64) * 64

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column("v")
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float) if len(lists) else np.zeros(0)
            bits = np.zeros((len(sizes), width), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bits[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.nan_to_num(flat, nan=0.0) > 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["id", "code"])

    return rows.mapInArrow(bytescan.tidy(pack), "id bigint, code binary")


def layout(n: int, width: int) -> tuple[list[tuple[int, int]], int]:
    """Segments (first bit, bits) of codes of ``width`` bits for n rows, and the bits that make a value's part."""
    bits = min(30, max(4, round(math.log2(max(2, n)))))
    number = math.ceil(width / bits)
    cuts = [width * k // number for k in range(number + 1)]
    part = max(0, math.ceil(math.log2(max(1, n) / PART_CODES)))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], min(part, min(b - a for a, b in zip(cuts, cuts[1:])))


def masks(bits: int, ones: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``ones`` of them set."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), ones)], np.int64)


def _values(codes: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Values of one segment of rows of bytes."""
    own = np.unpackbits(codes[:, first // 8 : (first + bits + 7) // 8], axis=1)[:, first % 8 : first % 8 + bits]
    return own.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)[::-1])


class Chunk:
    """Rows of one part of one segment table, by their values' low bits."""

    def __init__(self, segment: tuple[int, int], part: int, part_bits: int, ids: np.ndarray, codes: np.ndarray):
        self.segment, self.part, self.low_bits = segment, part, segment[1] - part_bits
        self.low = (1 << self.low_bits) - 1
        low = _values(codes, *segment) & self.low
        order = np.argsort(low, kind="stable")
        self.ids, self.words, self.values = ids[order], codes.view(np.uint64)[order], low[order]
        self.direct = self.low_bits <= 16
        if self.direct:
            self.upto = np.searchsorted(self.values, np.arange(self.low + 2))

    def _found(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.direct:
            return self.upto[probes], self.upto[probes + 1]
        return np.searchsorted(self.values, probes), np.searchsorted(self.values, probes, side="right")

    def near(self, ids: np.ndarray, codes: np.ndarray, bound: np.ndarray, radius: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The k nearest (query id, id, distance) of each query among the rows whose value differs in ``radius`` bits, within its bound."""
        value, words = _values(codes, *self.segment), codes.view(np.uint64)
        apart = np.bitwise_count(value >> self.low_bits ^ self.part).astype(np.int64)
        for d in np.unique(apart):
            if not 0 <= radius - d <= self.low_bits:
                continue
            flips, own = masks(self.low_bits, radius - d), np.flatnonzero(apart == d)
            each = max(1, STEP // max(len(flips), len(self.ids)))
            for a in range(0, len(own), each):
                q = own[a : a + each]
                start, end = self._found((value[q] & self.low)[:, None] ^ flips[None])
                n = (end - start).ravel()
                row = np.repeat(start.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                asks = np.repeat(q, (end - start).sum(axis=1))
                far = np.bitwise_count(self.words[row] ^ words[asks]).sum(axis=1).astype(np.int64)
                keep = (far <= bound[asks]) & (self.ids[row] != ids[asks])
                row, asks, far = row[keep], asks[keep], far[keep]
                order = np.lexsort((self.ids[row], far, asks))
                row, asks, far = row[order], asks[order], far[order]
                first = np.searchsorted(asks, asks)
                best = np.arange(len(asks)) - first < k
                yield ids[asks[best]], self.ids[row[best]], far[best]


def _round(index: DataFrame, asked: DataFrame, segments: list[tuple[int, int]], part_bits: int, radius: int, k: int) -> DataFrame:
    """(query_id, id, distance) of candidates whose value in some segment differs from the query's in ``radius`` bits."""
    near = ",".join(str(m) for r in range(min(radius, part_bits) + 1) for m in masks(part_bits, r))
    places = F.transform(F.lit(list(range(len(segments)))), lambda s: F.struct(s.alias("segment"), F.get("parts", s).alias("part")))
    asked = asked.select("id", "code", "bound", F.explode(places).alias("at")).select("id", "code", "bound", "at.*")
    asked = asked.withColumn("part", F.explode(F.transform(F.split(F.lit(near), ",").cast("array<int>"), lambda m: m.bitwiseXOR(F.col("part")))))
    sizes = index.groupBy("segment", "part").agg((F.max("chunk") + 1).alias("chunks"))
    splits = asked.groupBy("segment", "part").agg(F.ceil(F.count("*") / SPLIT_QUERIES).cast("int").alias("splits"))
    dealt = asked.join(sizes, ["segment", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.join(splits, ["segment", "part"]).select(
        "segment", "part", "chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("splits")).cast("int").alias("split"), F.lit(1).alias("role"), "id", "code", "bound"
    )
    held = index.join(splits, ["segment", "part"]).select("segment", "part", "chunk", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(0).alias("role"), "id", "code", F.lit(0).alias("bound"))
    keys = ["segment", "part", "chunk", "split"]
    rows = held.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys, "role")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, chunk = None, [], None
        for batch in stream:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in (*keys, "role")], axis=1)
            ids, bound = batch.column("id").to_numpy(), batch.column("bound").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                *own, role = at[a].tolist()
                if own != group:
                    group, held, chunk = own, [], None
                if role == 0:
                    held.append((ids[a:b], codes[a:b]))
                elif held:
                    if chunk is None:
                        chunk = Chunk(segments[own[0]], own[1], part_bits, np.concatenate([x for x, _ in held]), np.ascontiguousarray(np.concatenate([y for _, y in held])))
                    for found in chunk.near(ids[a:b], np.ascontiguousarray(codes[a:b]), bound[a:b], radius, k):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "id", "distance"])

    return rows.mapInArrow(bytescan.tidy(search), "query_id bigint, id bigint, distance bigint")


def top_k(codes: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance) for the rows of ``codes`` (id, code) that ``is_query`` picks."""
    rows = written(codes.dropDuplicates(["id"]), "codes")
    alike = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = written(rows.withColumn("nth", alike).where(F.col("nth") <= k + 1).select("id", "code"), "distinct-codes")
    n, size = few.agg(F.count("*"), F.coalesce(F.max(F.length("code")), F.lit(8))).first()
    segments, part_bits = layout(n, 8 * size)

    def parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            found = [_values(own, *s) >> (s[1] - part_bits) for s in segments] if batch.num_rows else []
            lists = pa.array(np.stack(found, axis=1).astype(np.int32).tolist() if found else [], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), lists], ["id", "code", "parts"])

    placed = few.mapInArrow(bytescan.tidy(parts), "id bigint, code binary, parts array<int>").select("id", "code", F.posexplode("parts").alias("segment", "part"))
    placed = written(placed, "segment-rows")
    chunks = placed.groupBy("segment", "part").agg(F.ceil(F.count("*") / PART_CODES).cast("int").alias("chunks"))
    index = written(placed.join(chunks, ["segment", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks"), "segment-index")
    open_ = written(rows.where(is_query).mapInArrow(bytescan.tidy(parts), "id bigint, code binary, parts array<int>").withColumn("bound", F.lit(8 * size)), "open-queries")
    best = None
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    for radius in range(max(b for _, b in segments) + 1):
        found = _round(index, open_, segments, part_bits, radius, k)
        found = (found if best is None else found.unionByName(best.drop("rank"))).dropDuplicates(["query_id", "id"])
        new = written(found.withColumn("rank", place).where(F.col("rank") <= k), "nearest")
        held = new.groupBy("query_id").agg(F.count("*").alias("found"), F.max("distance").alias("kth"))
        held = open_.join(held, F.col("id") == F.col("query_id"), "left")
        proven = (F.col("found") >= min(k, n - 1)) & ((F.col("found") < k) | (F.col("kth") <= len(segments) * (radius + 1) - 1))
        more = held.where(~F.coalesce(proven, F.lit(n <= 1)))
        rest = written(more.select("id", "code", "parts", F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(8 * size)).cast("int").alias("bound")), "open-queries")
        discard(open_, *([best] if best is not None else []))
        best, open_ = new, rest
        if open_.isEmpty():
            break
    discard(index, placed, few, rows, open_)
    return best.select("query_id", "rank", "id", "distance")
