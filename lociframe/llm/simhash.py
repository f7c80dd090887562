"""SimHash near duplicates, joined by a hierarchical index in Gray order.

1. A document's fingerprint: XXH64 of its word shingles, repeats included; a bit is set where it is
   set in over half of them. Equal fingerprints are one class; only classes go on.
2. Classes are sorted by Gray rank (the fingerprint read as a Gray code), in which neighbours differ
   in few bits, and cut into blocks of BLOCK. A node of the index factors out what all fingerprints
   below it share: a mask of the common bits and their pattern. Blocks have upper nodes of FAN
   children each, up to one root.
3. Pairs of nodes are followed from the root down. The differences on bits that both nodes share hold
   for every pair below, so a pair of nodes with over ``most`` of them is pruned as a whole. What is
   left are pairs of blocks; inside them the same descent goes on over runs of LEVELS fingerprints,
   and the last runs are compared in full.
4. A pair of blocks gives the forest of its links, not all of them, so a group of near copies has
   links in proportion to its members. Components of the links by star contraction.

Scale: texts are read once and never shuffled. A pair of blocks moves one block; a block's partners
are dealt into parts of PART_BLOCKS that share one copy of it. The join is exact; what it prunes
depends on the number of fingerprints alone, so its share of pairs falls as they grow.

Defined results: a null text or one without words has fingerprint zero and is linked like any other;
fewer words than the width are one shingle; rows that repeat are one class; a component's name is its
smallest key that is not null, and null where all keys are; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import bytescan
from .common import discard, written
from .components import components

WIDTH = 4
SEED = 42
#: Fingerprints of a block, and children of an upper node.
BLOCK = 1 << 14
FAN = 32
#: A block's rows in the table: PIECE fingerprints each.
PIECE = 512
#: Runs inside a block and a piece, from the coarse to those compared in full.
LEVELS = (512, 64, 16)
PART_BLOCKS = 16
SLICE_BYTES = 1 << 19
#: Pairs of nodes or fingerprints that are looked at together.
STEP = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """SimHash of one text."""
    words = (text or "").encode().translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(width, len(words))
    view, hashed = memoryview(flat), xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for a in range(0, n, 1 << 14):  # long texts in steps
        b = min(n, a + (1 << 14))
        spans = zip(starts[a:b].tolist(), (ends[a + k - 1 : b + k - 1] - 1).tolist(), strict=True)
        values = np.fromiter((hashed(view[s:e], SEED) for s, e in spans), np.uint64, b - a)
        counts += np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * counts > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                found = np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(found)], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(bytescan.tidy(scan), f"key {kind}, fp bigint")


def gray_rank(code: Column) -> Column:
    """Rank of a code in the reflected Gray order, ordered as a signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bits that all codes of each run share, and their patterns."""
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return every | (some ^ _FULL), every


class Tree:
    """Runs of sorted codes at each of LEVELS with their masks and patterns; the codes are the last level."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = []
        for run in LEVELS:
            self.levels.append((*shared(codes, np.arange(0, len(codes), run)), run))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level."""
        run = self.levels[level][2]
        below = self.levels[level + 1][2] if level + 1 < len(LEVELS) else 1
        first = node * (run // below)
        last = np.minimum((node + 1) * run, len(self.codes))
        return first, -(-last // below) - first


def _expanded(first: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n children from first with m children from other, for each row."""
    each = n * m
    row = np.repeat(np.arange(len(n)), each)
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return first[row] + place // m[row], other[row] + place % m[row]


def close_pairs(left: Tree, right: Tree, most: int, level: int = 0, a: np.ndarray | None = None, b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of codes of both trees that differ in ``most`` bits at most, some at a time."""
    if a is None:
        tops = len(left.levels[0][0]), len(right.levels[0][0])
        a, b = np.repeat(np.arange(tops[0]), tops[1]), np.tile(np.arange(tops[1]), tops[0])
    if level == len(LEVELS):
        near = np.bitwise_count(left.codes[a] ^ right.codes[b]) <= most
        if near.any():
            yield a[near], b[near]
        return
    (lm, lv, _), (rm, rv, _) = left.levels[level], right.levels[level]
    open_ = np.bitwise_count((lv[a] ^ rv[b]) & lm[a] & rm[b]) <= most
    a, b = a[open_], b[open_]
    widest = (LEVELS[level] // (LEVELS[level + 1] if level + 1 < len(LEVELS) else 1)) ** 2
    step = max(1, STEP // widest)
    for k in range(0, len(a), step):
        first, n = left.children(level, a[k : k + step])
        other, m = right.children(level, b[k : k + step])
        yield from close_pairs(left, right, most, level + 1, *_expanded(first, n, other, m))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (a, b): each node to the smallest it reaches."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[root[moved]], names[moved]


def blocks(classes: DataFrame) -> DataFrame:
    """(part, nth, piece, mask, pattern, codes): the Gray-sorted fingerprints in blocks (part, nth), one row for each piece.

    mask and pattern are those of the whole block.
    """

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

        def told(codes: np.ndarray) -> pa.RecordBatch:
            mask, pattern = shared(codes.view(np.uint64), np.zeros(1, np.int64))
            pieces = [codes[k : k + PIECE].tobytes() for k in range(0, len(codes), PIECE)]
            same = [np.full(len(pieces), x, np.int64) for x in (part, nth)]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, same), pa.array(np.arange(len(pieces))), *(pa.array(np.repeat(x.view(np.int64), len(pieces))) for x in (mask, pattern)), pa.array(pieces, pa.binary())],
                ["part", "nth", "piece", "mask", "pattern", "codes"],
            )

        for batch in stream:
            held = np.concatenate([held, batch.column("fp").to_numpy()])
            while len(held) >= BLOCK:
                yield told(held[:BLOCK])
                held, nth = held[BLOCK:], nth + 1
        if len(held):
            yield told(held)

    ordered = classes.withColumn("place", gray_rank(F.col("fp"))).repartitionByRange("place").sortWithinPartitions("place")
    return ordered.select("fp").mapInArrow(bytescan.tidy(cut), "part bigint, nth bigint, piece bigint, mask bigint, pattern bigint, codes binary")


def close_blocks(leaves: DataFrame, most: int) -> DataFrame:
    """(a, b) with a <= b of blocks (node, mask, pattern) numbered in Gray order that could hold a link.

    Upper nodes are built from FAN children each; pairs are followed from the root down.
    """
    levels = [leaves]
    while levels[-1].count() > 1:
        low = levels[-1]
        every = F.bit_and("pattern")
        ones = F.bit_or(F.col("pattern").bitwiseOR(F.bitwise_not("mask")))
        zeros = F.bit_and(F.col("pattern").bitwiseAND(F.col("mask")))
        shared_bits = F.bit_and("mask").bitwiseAND(F.bitwise_not(ones.bitwiseXOR(zeros)))
        levels.append(written(low.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(shared_bits.alias("mask"), every.alias("pattern")), "gray-nodes"))
    root = levels[-1]
    pairs = written(root.select(F.col("node").alias("a"), F.col("node").alias("b")), "gray-pairs")
    for low in reversed(levels[:-1]):
        child = low.withColumn("up", F.floor(F.col("node") / FAN))
        left = child.select(F.col("up").alias("a"), F.col("node").alias("x"), F.col("mask").alias("xm"), F.col("pattern").alias("xp"))
        right = child.select(F.col("up").alias("b"), F.col("node").alias("y"), F.col("mask").alias("ym"), F.col("pattern").alias("yp"))
        differ = F.bit_count(F.col("xp").bitwiseXOR(F.col("yp")).bitwiseAND(F.col("xm")).bitwiseAND(F.col("ym")))
        open_ = pairs.join(left, "a").join(right, "b").where((F.col("x") <= F.col("y")) & (differ <= most))
        done, pairs = pairs, written(open_.select(F.col("x").alias("a"), F.col("y").alias("b")), "gray-pairs")
        discard(done)
    for table in levels[1:]:
        discard(table)
    return pairs


def links(classes: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links of distinct fingerprints ``classes`` (fp) that have the components of all links of ``most`` bits or fewer."""
    cut = written(blocks(classes), "gray-blocks")
    # blocks are numbered by part and place, which keeps the Gray order
    most_blocks = cut.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0] + 1
    numbered = written(cut.withColumn("node", F.col("part") * (1 << (most_blocks - 1).bit_length()) + F.col("nth")).select("node", "piece", "mask", "pattern", "codes"), "gray-leaves")
    pairs = close_blocks(numbered.where("piece = 0").select("node", "mask", "pattern"), most)
    dealt = pairs.withColumn("part", F.floor((F.col("b") - F.col("a")) / PART_BLOCKS))
    heads = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("member"))
    tails = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("member"))
    rows = heads.unionByName(tails).join(numbered.select("node", "piece", "codes"), F.col("member") == F.col("node")).select("a", "part", "role", "member", "piece", "codes")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "member", "piece")

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, own = None, [], None
        a, b, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def settle() -> None:
            nonlocal a, b, more
            if more:
                a, b = forest(*(np.concatenate([x, *y]) for x, y in zip((a, b), zip(*more), strict=True)))
                more = []

        for batch in stream:
            named = zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "codes")), strict=True)
            for first, part, role, raw in named:
                codes = np.frombuffer(raw, np.uint64)
                if (first, part) != unit:
                    settle()
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    unit, parts, own = (first, part), [], None
                    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if role == 0:
                    parts.append(codes)
                    continue
                own = own or Tree(np.concatenate(parts))
                other = Tree(codes)
                for i, j in close_pairs(own, other, most):
                    x, y = own.codes[i].view(np.int64), other.codes[j].view(np.int64)
                    more.append((x[x != y], y[x != y]))
                    if sum(len(x) for x, _ in more) > STEP:
                        settle()
        settle()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = written(rows.mapInArrow(bytescan.tidy(join), "a bigint, b bigint"), "gray-links")
    discard(cut, numbered, pairs)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, most: int = 4) -> DataFrame:
    """Per row of ``docs``: key, fp (fingerprint as a signed long), component (smallest key reachable over links)."""
    rows = written(fingerprints(docs, key, text, width), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-classes")
    found = links(classes.select("fp"), most)
    labels = components(found)
    reps = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # written, so that the join back is one whose hot fingerprint can be split
    firsts = written(reps.groupBy("component").agg(F.min("first").alias("smallest")), "fingerprint-firsts")
    named = reps.join(firsts, "component").select("fp", F.col("smallest").alias("component"))
    return rows.join(named, "fp").select("key", "fp", "component")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
