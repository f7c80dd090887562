"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most CAPACITY tokens (a separator ends each document; only longer
ones are cut, the first piece being the short one). The histogram of piece lengths has at most
CAPACITY entries however many documents there are. Best fit in order of falling length runs over
its counts: sequences with the same room are one class, and a length's whole count moves through
the fullest class that fits at once. The plan says which ranks of a length go to which run of
sequences at which offset; pieces find their slot by joining on length and rank within length.

Scale: one pass tokenizes and writes one small row for each piece. Ranks come from windows over
(length, part), a length having as many parts as its count asks for, so a length that holds a
third of the pieces is spread; the split a piece was read from counts too, so that one row that
repeats doesn't fill a part. The plan's size depends on CAPACITY, not on the input.

Defined results: a null or empty text is a piece of the separator alone; rows that repeat are
packed one by one; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import written
from .tokens import Encoder

CAPACITY = 2048
SEPARATOR = 0
PART_ROWS = 20_000
SLICE_BYTES = 1 << 21


@dataclass(frozen=True)
class Run:
    """Pieces of one length by rank: ``each`` of them in each of ``n`` sequences from ``first`` on, at ``offset``."""

    length: int
    rank: int
    items: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit by falling length over the counts of pieces of each length."""
    rooms: list[int] = []  # of open classes, rising
    classes: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                bisect.insort(rooms, room)
                classes[room] = []
            last = classes[room][-1] if classes[room] else (0, 0)
            if last[1] and sum(last) == first:
                classes[room][-1] = (last[0], last[1] + n)
            else:
                classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // length
            if k < len(rooms):
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(k)
            else:
                first, n = opened, math.ceil(left / each)
                opened += n
            full, rest = min(n, left // each), 0
            if full:
                runs.append(Run(length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                rest = left
                runs.append(Run(length, rank, rest, first + full, rest, capacity - room))
                rank, left = rank + rest, 0
            put(room, first + full + bool(rest), n - full - bool(rest))
            put(room - rest * length, first + full, int(bool(rest)))
            put(room - each * length, first, full)
    return runs


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, crc (of the ids as little-endian 32-bit), and the ids if asked for."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in stream:
            for a, _, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                at, piece, start, length, crc, parts = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts), a):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    begin, end = 0, len(ids) % capacity or capacity
                    for n in range(math.ceil(len(ids) / capacity)):
                        own = ids[begin:end]
                        at.append(k)
                        piece.append(n)
                        start.append(begin)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            parts.append(own.astype(np.int32))
                        begin, end = end, end + capacity
                columns = [batch.column("key").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, ["key", "piece", "start", "length", "crc"] + ["ids"] * with_ids)

    return source.mapInArrow(bytescan.tidy(cut), f"key {kind}, piece int, start bigint, length bigint, crc bigint" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, key, text, capacity, with_ids).withColumn("split", F.spark_partition_id()), "pack-pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    parts = spark.createDataFrame([(n, math.ceil(c / PART_ROWS)) for n, c in counts.items()], "of_length long, parts int")
    part = F.pmod(F.xxhash64("key", "piece", "crc", "split"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(parts), F.col("length") == F.col("of_length")).withColumn("part", part).drop("parts", "of_length", "split")
    within = Window.partitionBy("length", "part").orderBy("key", "piece", "crc")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).drop("part", "earlier")
    slots = spark.createDataFrame(
        [(r.length, r.rank, r.rank + r.items, r.first, r.each, r.offset) for r in runs],
        "of_length long, rank_from long, rank_to long, first long, each long, at long",
    )
    if len(runs) <= 100_000:
        slots = F.broadcast(slots)
    own = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    nth = F.col("rank") - F.col("rank_from")
    placed = ranked.join(slots, own)
    return placed.select(
        "key", "piece", "start", "length", "crc", *["ids"] * with_ids,
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Per sequence: sequence_id, the packed ids and the keys in order; at most the capacity in one group."""
    rows = pack(docs, tokenizer, with_ids=True, **options)
    own = F.array_sort(F.collect_list(F.struct("offset", "ids", "key")))
    packed = rows.groupBy("sequence_id").agg(own.alias("own"))
    return packed.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), F.transform("own", lambda x: x["key"]).alias("keys"))
