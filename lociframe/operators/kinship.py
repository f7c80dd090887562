"""Relationship matrices as sums of products over tiles of samples, and their spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encode

#: Samples in one tile of a relationship matrix.
TILE = 1024
#: Variants whose values one row packs.
CHUNK = 64
#: Variants of one row, values of one stripe and products of a stripe and a tile in `nearest`.
WIDE, HELD, BLOCK = 256, 1 << 24, 1 << 22
#: Values that a task of a pair of groups of tiles holds, one byte each where a variant has few.
GROUPED = 1 << 25
#: Samples up to which a matrix may come to the driver: 2 GB.
MOST_SAMPLES = 16_000


def encoded(cells: DataFrame, kind: str = "vanraden", ploidy: int = 2, weights: DataFrame | None = None) -> DataFrame:
    """(v_idx, s_idx, x, norm) of mean-imputed cells; norm is the variant's part of the divisor. Other columns of cells stay.

    In the centred kinds (vanraden, slater, yang, weighted) a call at the mean is 0, so the known
    calls alone give the same products; the others need a cell for each sample.
    """
    own = Window.partitionBy("v_idx")
    extra = [c for c in cells.columns if c not in ("v_idx", "s_idx", "dosage")]
    if ":" in kind:
        # the relationship of calls recoded for a gene action, as of a lower ploidy
        action = kind.partition(":")[2]
        ploidies = {"additive": ploidy, "general": ploidy, "diplo-additive": ploidy // 2}
        recoded = cells.withColumn("dosage", encode.gene_action(F.coalesce(F.col("dosage"), F.avg("dosage").over(own)), "additive" if action == "general" else action, ploidy))
        return encoded(recoded, "vanraden", ploidies.get(action, 1))
    if kind == "pseudo_diploid":
        filled = F.coalesce(F.col("dosage"), F.avg("dosage").over(own))
        return encoded(cells.withColumn("dosage", F.round(2 * filled / ploidy)), "vanraden", 2)
    d = F.coalesce(F.col("dosage"), F.avg("dosage").over(own))
    rows = cells.withColumn("d", d).withColumn("p", F.avg("d").over(own) / ploidy)
    p, q, g = F.col("p"), 1 - F.col("p"), F.col("d")
    if kind == "weighted":
        rows = rows.join(weights.select("v_idx", "weight"), "v_idx")
        x, norm = F.sqrt("weight") * (g - ploidy * p), F.col("weight") * ploidy * p * q
    elif kind == "yang":
        rows = rows.where((F.col("p") > 0) & (F.col("p") < 1))
        x, norm = (g - ploidy * p) / F.sqrt(ploidy * p * q), F.lit(1.0)
    elif kind == "dominance" and ploidy == 2:
        x = F.when(F.round(g) == 0, -2 * p * p).when(F.round(g) == 1, 2 * p * q).otherwise(-2 * q * q)
        norm = F.pow(2 * p * q, 2) / 2
    elif kind == "dominance":
        h = g * (ploidy - g) / (ploidy / 2) ** 2
        x, norm = h * 2 * p * q - (1 - h) * 2 * p * q, F.pow(2 * p * q, 2) / 2
    elif kind == "su":
        x, norm = F.when(F.round(g) == 1, 1 - 2 * p * q).otherwise(-2 * p * q), p * q * (1 - p * q)
    elif kind == "digenic":
        x, norm = 6 * p * p - 3 * p * g + g * (g - 1) / 2, 6 * p * p * q * q
    elif kind == "slater":
        x, norm = g - ploidy * p, ploidy * p * (ploidy - ploidy * p)
    elif kind in ("vanraden", "centred"):
        x, norm = g - ploidy * p, ploidy * p * q
        rows = rows if kind == "vanraden" else rows.where((F.col("p") > 0) & (F.col("p") < 1))
    else:
        raise ValueError(f"unknown relationship {kind}")
    return rows.select("v_idx", "s_idx", x.alias("x"), norm.alias("norm"), *extra)


def _coded(x: np.ndarray) -> tuple[bytes, bytes]:
    """A matrix as one byte a value and each row's levels; as it is, without levels, where a row has more than 256."""
    codes, levels = np.empty(x.shape, np.uint8), np.zeros((len(x), 256))
    for k, row in enumerate(x):
        own, at = np.unique(row, return_inverse=True)
        if len(own) > 256:
            return x.tobytes(), b""
        codes[k], levels[k, : len(own)] = at, own
    used = int(codes.max(initial=0)) + 1
    return codes.tobytes(), levels[:, :used].tobytes()


def _decoded(x, levels, rows: int, columns: int) -> np.ndarray:
    if not len(levels):
        return np.frombuffer(x).reshape(rows, columns)
    table = np.frombuffer(levels).reshape(rows, -1)
    return np.take_along_axis(table, np.frombuffer(x, np.uint8).reshape(rows, columns).astype(np.intp), axis=1)


def tiles(rows: DataFrame, samples: list[int], tile: int = TILE, by: str | None = None, variants: int | None = None) -> DataFrame:
    """(ti, tj, k) for ti <= tj: X X' over (v_idx, s_idx, x) as one binary matrix of doubles for each pair of tiles, by a column if asked for.

    The values of CHUNK variants and a tile of samples are packed to one row, one byte a value where a
    variant has few of them, which goes to each pair its tile takes part in. A task adds up the
    products of its rows pair by pair and passes on one matrix for each; only where there are fewer
    pairs than tasks a second pass adds the tasks' matrices. Nothing comes to the driver; a task
    holds the values of two rows and one product. Where there are many more pairs than tasks, tiles
    go in groups, and a task holds the rows of two groups, at most GROUPED values: what is shuffled
    is the values times the number of groups, which follows the cores. ``variants``, no fewer than there
    are, saves counting them.
    """
    order = np.array(sorted(samples), np.int64)
    n_tiles = max(1, -(-len(order) // tile))
    n_pairs = n_tiles * (n_tiles + 1) // 2
    spark = rows.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    parts = max(1, parallel // n_pairs)
    keys = ["ti", "tj"] + [by] * bool(by)
    own = [by] * bool(by)
    own_types = "".join(f"{c} {dict(rows.dtypes)[c]}, " for c in own)
    size = lambda t: min(len(order), (t + 1) * tile) - t * tile
    edges = ",".join(str(order[min(len(order), (k + 1) * tile) - 1]) for k in range(n_tiles)) if len(order) else "0"
    place = F.size(F.filter(F.split(F.lit(edges), ",").cast("array<bigint>"), lambda e: e < F.col("s_idx")))
    packed = rows.groupBy(F.floor(F.col("v_idx") / CHUNK).alias("chunk"), place.alias("t"), *own).agg(F.collect_list(F.struct("v_idx", "s_idx", "x")).alias("c"))

    def dense(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                c = batch.column("c")[k].values
                names, at = np.unique(c.field("v_idx").to_numpy(), return_inverse=True)
                t = batch.column("t")[k].as_py()
                x = np.zeros((len(names), size(t)))
                x[at, np.searchsorted(order, c.field("s_idx").to_numpy()) - t * tile] = c.field("x").to_numpy()
                blobs = [pa.array([b], pa.binary()) for b in (names.astype(np.int64).tobytes(), *_coded(x))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(k, 1) for n in ("chunk", "t", *own)), *blobs], ["chunk", "t", *own, "v", "x", "levels"])

    packed = packed.mapInArrow(dense, f"chunk bigint, t int, {own_types}v binary, x binary, levels binary")
    if not by and (group := _group(rows, n_tiles, tile, parallel, variants)) > 1:
        return _grouped(packed, group, n_tiles, size)
    packed = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("o"))
    pairs = packed.select(F.least("t", "o").alias("ti"), F.greatest("t", "o").alias("tj"), F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), "chunk", "t", *own, "v", "x", "levels")
    # a pair's blocks are a few MB: a task sorts some pairs at once, not a share that grows with their number
    pairs = pairs.repartition(min(8192, max(parallel, n_pairs * parts // 8)), *keys, "part").sortWithinPartitions(*keys, "part", "chunk", "t")
    schema = f"ti int, tj int, {own_types}k binary"

    def added(stream: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
        """One row for each run of equal keys, with the sum of ``value`` over it."""
        key, total, last = None, None, None
        for batch in stream:
            columns = [batch.column(c) for c in keys]
            for k in range(batch.num_rows):
                now = tuple(c[k].as_py() for c in columns)
                if now != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([*last, pa.array([total.tobytes()], pa.binary())], [*keys, "k"])
                    key, total, last = now, np.zeros((size(now[0]), size(now[1]))), [c.slice(k, 1) for c in columns]
                found = value(batch, k, now)
                if found is not None:
                    total += found
        if key is not None:
            yield pa.RecordBatch.from_arrays([*last, pa.array([total.tobytes()], pa.binary())], [*keys, "k"])

    def products(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of the pair's first tile waits for that of the second with the same variants."""
        held: dict = {}

        def value(batch: pa.RecordBatch, k: int, key: tuple) -> np.ndarray | None:
            chunk, t = batch.column("chunk")[k].as_py(), batch.column("t")[k].as_py()
            blob = lambda c: batch.column(c)[k].as_buffer()
            names = np.frombuffer(blob("v"), np.int64)
            x = _decoded(blob("x"), blob("levels"), len(names), size(t))
            if key[0] == key[1]:
                return x.T @ x
            if t == key[0]:
                held.clear()
                held[key, chunk] = names, x
                return None
            if (key, chunk) not in held:
                return None
            others, left = held.pop((key, chunk))
            _, a, b = np.intersect1d(others, names, assume_unique=True, return_indices=True)
            return left[a].T @ x[b]

        return added(stream, value)

    def stored(batch: pa.RecordBatch, k: int, key: tuple) -> np.ndarray:
        return np.frombuffer(batch.column("k")[k].as_buffer()).reshape(size(key[0]), size(key[1]))

    first = pairs.mapInArrow(products, schema)
    if parts == 1:
        return first
    return first.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda stream: added(stream, stored), schema)


def _group(rows: DataFrame, n_tiles: int, tile: int, parallel: int, variants: int | None) -> int:
    """Tiles of a group: as many as leave some pairs of groups for each core, and as a task may hold."""
    groups = 1
    while groups * (groups + 1) // 2 < 8 * parallel:
        groups += 1
    if n_tiles <= groups:
        return 1
    if variants is None:
        variants = rows.agg(F.approx_count_distinct("v_idx")).first()[0]
    return max(1, min(-(-n_tiles // groups), GROUPED // max(1, 2 * tile * variants)))


def _grouped(packed: DataFrame, group: int, n_tiles: int, size) -> DataFrame:
    """(ti, tj, k) of packed rows by pairs of groups of tiles."""
    groups = -(-n_tiles // group)
    mine = F.floor(F.col("t") / group).cast("int")
    dealt = packed.withColumn("g", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select(F.least("g", "o").alias("gi"), F.greatest("g", "o").alias("gj"), "t", "chunk", "v", "x", "levels")
    # each pair by itself: its number among the pairs
    pair = (F.col("gi") * groups - F.col("gi") * (F.col("gi") - 1) / 2 + F.col("gj") - F.col("gi")).cast("int")
    count = groups * (groups + 1) // 2
    dealt = dealt.withColumn("pair", pair).repartitionById(min(8192, count), F.pmod("pair", F.lit(min(8192, count)))).sortWithinPartitions("pair", "t", "chunk")

    def products(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in stream:
            for r in range(batch.num_rows):
                key = batch.column("gi")[r].as_py(), batch.column("gj")[r].as_py()
                if key != now:
                    yield from meet(now, held)
                    now, held = key, {}
                held.setdefault(batch.column("t")[r].as_py(), {})[batch.column("chunk")[r].as_py()] = tuple(batch.column(c)[r].as_py() for c in ("v", "x", "levels"))
        yield from meet(now, held)

    def opened(blobs: tuple, t: int) -> tuple[np.ndarray, np.ndarray]:
        names = np.frombuffer(blobs[0], np.int64)
        return names, _decoded(blobs[1], blobs[2], len(names), size(t))

    def meet(key: tuple | None, held: dict) -> Iterator[pa.RecordBatch]:
        for ti in sorted(t for t in held if t // group == key[0]):
            left = {chunk: opened(b, ti) for chunk, b in held[ti].items()}
            for tj in sorted(t for t in held if t // group == key[1] and t >= ti):
                total = np.zeros((size(ti), size(tj)))
                for chunk, b in held[tj].items():
                    if chunk not in left:
                        continue
                    (names, x), (others, z) = left[chunk], left[chunk] if ti == tj else opened(b, tj)
                    if np.array_equal(names, others):
                        total += x.T @ z
                    else:
                        _, a, c = np.intersect1d(names, others, assume_unique=True, return_indices=True)
                        total += x[a].T @ z[c]
                yield pa.RecordBatch.from_arrays([pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["ti", "tj", "k"])

    return dealt.mapInArrow(products, "ti int, tj int, k binary")


def _norm(rows: DataFrame, by: str | None = None) -> DataFrame:
    own = [by] * bool(by)
    return rows.groupBy("v_idx", *own).agg(F.max("norm").alias("norm")).groupBy(*own).agg(F.sum("norm").alias("norm"))


def _checked(samples: list[int]) -> None:
    if len(samples) > MOST_SAMPLES:
        raise ValueError(f"a matrix of {len(samples)} samples is too large for the driver; use the table of pairs, or a low rank")


def _assembled(found: DataFrame, n: int, tile: int, by: str | None = None) -> dict:
    """Full matrices from tiles, by the values of a column."""
    out: dict = {}
    for r in found.toLocalIterator():
        k = out.setdefault(r[by] if by else None, np.zeros((n, n)))
        a, b = r["ti"] * tile, r["tj"] * tile
        piece = np.frombuffer(r["k"]).reshape(min(n, a + tile) - a, min(n, b + tile) - b)
        k[a : a + tile, b : b + tile] = piece
        k[b : b + tile, a : a + tile] = piece.T
    return out


def gram(rows: DataFrame, samples: list[int], tile: int = TILE) -> tuple[np.ndarray, float]:
    """X X' over (v_idx, s_idx, x) and the sum of norms, on the driver; at most MOST_SAMPLES samples."""
    _checked(samples)
    rows = rows.persist()
    k = _assembled(tiles(rows, samples, tile), len(samples), tile).get(None, np.zeros((len(samples), len(samples))))
    norm = _norm(rows).first()["norm"] or 0.0
    rows.unpersist()
    return k, norm


def gram_pairs(rows: DataFrame, samples: list[int] | None = None, tile: int = TILE, least: float = 0.0, variants: int | None = None) -> DataFrame:
    """(i, j, k) with i <= j as a table: for sample numbers that no driver matrix holds. Pairs of different samples below ``least`` are left out where they are made."""
    order = np.array(sorted(samples if samples is not None else (r["s_idx"] for r in rows.select("s_idx").distinct().toLocalIterator())), np.int64)
    n = len(order)

    def unfold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for ti, tj, k, norm in zip(*(batch.column(c).to_pylist() for c in ("ti", "tj", "k", "norm")), strict=True):
                left, right = order[ti * tile : (ti + 1) * tile], order[tj * tile : (tj + 1) * tile]
                values = np.frombuffer(k).reshape(len(left), len(right)) / max(norm or 0.0, 1e-10)
                for a in range(0, len(left), max(1, (1 << 16) // max(1, len(right)))):
                    own = slice(a, a + max(1, (1 << 16) // max(1, len(right))))
                    i, j = np.repeat(left[own], len(right)), np.tile(right, len(left[own]))
                    keep = (i == j) | ((i < j) & (np.abs(values[own].ravel()) >= least))
                    yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(values[own].ravel()[keep])], ["i", "j", "k"])

    if not n:
        return rows.sparkSession.createDataFrame([], "i long, j long, k double")
    found = tiles(rows, order.tolist(), tile, variants=variants).crossJoin(F.broadcast(_norm(rows)))  # one row: the norm
    return found.mapInArrow(unfold, "i bigint, j bigint, k double")


def nearest(rows: DataFrame, k: int = 5, samples: int | None = None, digits: int = 9, stripes: int | None = None) -> DataFrame:
    """(s_idx, other, w): the k others of largest X X' / norm for each sample, rounded, ties to the smaller one; of all pairs, none of which becomes a row.

    Samples are dealt into stripes and into smaller tiles. A stripe is a task: it holds its own values
    and k candidates for each of its samples, and all tiles pass by it, so what is shuffled is the
    values times the number of stripes. That follows the cores; more are made only where a stripe
    would hold more than HELD values.
    """
    spark = rows.sparkSession
    if samples is None:
        samples = rows.select("s_idx").distinct().count()
    if stripes is None:
        variants = rows.agg(F.approx_count_distinct("v_idx")).first()[0]
        stripes = max(2 * spark.sparkContext.defaultParallelism, -(-samples * variants // HELD))
    tile = max(64, min(TILE, BLOCK // max(1, samples // stripes)))
    per = max(1, -(-samples // (tile * stripes)))  # tiles of a stripe
    t = F.pmod(F.xxhash64("s_idx"), F.lit(per * stripes)).cast("int")
    packed = rows.groupBy(F.floor(F.col("v_idx") / WIDE).alias("chunk"), t.alias("t")).agg(F.collect_list(F.struct("v_idx", "s_idx", "x")).alias("c"))

    def dense(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in range(batch.num_rows):
                c = batch.column("c")[r].values
                names, v = np.unique(c.field("v_idx").to_numpy(), return_inverse=True)
                who, s = np.unique(c.field("s_idx").to_numpy(), return_inverse=True)
                x = np.zeros((len(names), len(who)))
                x[v, s] = c.field("x").to_numpy()
                blobs = [pa.array([b], pa.binary()) for b in (names.astype(np.int64).tobytes(), who.astype(np.int64).tobytes(), *_coded(x))]
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(r, 1), batch.column("t").slice(r, 1), *blobs], ["chunk", "t", "v", "s", "x", "levels"])

    packed = packed.mapInArrow(dense, "chunk bigint, t int, v binary, s binary, x binary, levels binary").crossJoin(F.broadcast(_norm(rows)))  # one row: the norm
    own = F.floor(F.col("t") / per).cast("int")
    meets = F.array(F.struct(own.alias("stripe"), F.lit(0).alias("passing")))
    meets = F.concat(meets, F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda o: F.struct(o.alias("stripe"), F.lit(1).alias("passing"))))
    dealt = packed.withColumn("to", F.explode(meets)).select("to.*", "t", "chunk", "v", "s", "x", "levels", "norm")
    dealt = dealt.repartitionById(stripes, "stripe").sortWithinPartitions("passing", "t", "chunk")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best, now, total = _Stripe(), None, None, None
        for batch in stream:
            blob = lambda c: batch.column(c)[r].as_buffer()  # noqa: B023, E731
            for r in range(batch.num_rows):
                names, who = np.frombuffer(blob("v"), np.int64), np.frombuffer(blob("s"), np.int64)
                x, chunk = _decoded(blob("x"), blob("levels"), len(names), len(who)), batch.column("chunk")[r].as_py()
                if not batch.column("passing")[r].as_py():
                    mine.add(chunk, names, who, x)
                    continue
                if best is None:
                    best = _Best(mine.close(), k, digits)
                if now != (t := batch.column("t")[r].as_py()):
                    if now is not None:
                        best.meet(*total)
                    now, total, norm = t, None, max(batch.column("norm")[r].as_py() or 0.0, 1e-10)
                total = mine.times(total, chunk, names, who, x / norm)
        if now is not None and best is not None:
            best.meet(*total)
            yield from best.rows()

    return dealt.mapInArrow(search, "s_idx bigint, other bigint, w double")


class _Stripe:
    """The values of a stripe's samples, by chunk of variants."""

    def __init__(self) -> None:
        self.parts: dict[int, list] = {}
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, chunk: int, names: np.ndarray, who: np.ndarray, x: np.ndarray) -> None:
        self.parts.setdefault(chunk, []).append((names, who, x))

    def close(self) -> np.ndarray:
        """The stripe's samples; chunks become one matrix each."""
        parts = [p for own in self.parts.values() for p in own]
        self.order = np.unique(np.concatenate([who for _, who, _ in parts])) if parts else np.zeros(0, np.int64)
        while self.parts:
            chunk, own = self.parts.popitem()
            names = np.unique(np.concatenate([v for v, _, _ in own]))
            values = np.zeros((len(names), len(self.order)))
            for v, who, x in own:
                values[np.ix_(np.searchsorted(names, v), np.searchsorted(self.order, who))] = x
            self.held[chunk] = names, values
        return self.order

    def times(self, total: tuple | None, chunk: int, names: np.ndarray, who: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passing samples and their products with the stripe's, ``total`` being those of the chunks before."""
        if chunk in self.held:
            own, values = self.held[chunk]
            if not np.array_equal(own, names):
                _, a, b = np.intersect1d(own, names, assume_unique=True, return_indices=True)
                values, x = values[a], x[b]
            k = values.T @ x
        else:
            k = np.zeros((len(self.order), len(who)))
        if total is None:
            return who, k
        if np.array_equal(total[0], who):
            total[1].__iadd__(k)
            return total
        # not all samples of a tile have calls in every chunk
        both = np.union1d(total[0], who)
        out = np.zeros((len(self.order), len(both)))
        out[:, np.searchsorted(both, total[0])] = total[1]
        out[:, np.searchsorted(both, who)] += k
        return both, out


class _Best:
    """The k others of largest rounded value for each sample of a stripe."""

    def __init__(self, order: np.ndarray, k: int, digits: int) -> None:
        self.order, self.k, self.digits, self.half = order, k, digits, 0.6 * 10.0**-digits
        self.w, self.j = np.full((len(order), k), -np.inf), np.full((len(order), k), np.iinfo(np.int64).max)

    def meet(self, who: np.ndarray, values: np.ndarray) -> None:
        n, k = len(self.order), self.k
        at = np.minimum(np.searchsorted(self.order, who), max(n - 1, 0))
        same = np.flatnonzero(self.order[at] == who) if n else []
        values[at[same], same] = -np.inf  # a sample and itself
        least = self.w[:, -1]
        if n and len(who) > k and np.isinf(least).any():
            # the first tile: what its own k best exclude
            least = np.maximum(least, np.partition(values, len(who) - k, axis=1)[:, len(who) - k])
        # what may reach the last place, ties included
        row, column = np.nonzero(values >= np.where(np.isinf(least), np.finfo(float).min, least - self.half)[:, None])
        w, j = np.round(values[row, column], self.digits), who[column]
        keep = (w > self.w[row, -1]) | ((w == self.w[row, -1]) & (j < self.j[row, -1]))
        row, w, j = row[keep], w[keep], j[keep]
        if not len(row):
            return
        some = np.unique(row)
        row, w, j = np.concatenate([row, np.repeat(some, k)]), np.concatenate([w, self.w[some].ravel()]), np.concatenate([j, self.j[some].ravel()])
        order = np.lexsort((j, -w, row))
        row, w, j = row[order], w[order], j[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.w[row[keep], place[keep]], self.j[row[keep], place[keep]] = w[keep], j[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.order), 1 << 14):
            w, j = self.w[a : a + (1 << 14)].ravel(), self.j[a : a + (1 << 14)].ravel()
            found = np.isfinite(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.order[a : a + (1 << 14)], self.k)[found]), pa.array(j[found]), pa.array(w[found])], ["s_idx", "other", "w"])


def sparse_pairs(rows: DataFrame, threshold: float = 0.05, samples: list[int] | None = None, tile: int = TILE, variants: int | None = None) -> DataFrame:
    """The pairs of `gram_pairs` whose relationship reaches the threshold, and all of a sample with itself."""
    return gram_pairs(rows, samples, tile, threshold, variants)


def relationship(cells: DataFrame, samples: list[int], kind: str = "vanraden", ploidy: int = 2, weights: DataFrame | None = None) -> np.ndarray:
    total, norm = gram(encoded(cells, kind, ploidy, weights), samples)
    return total / (norm if norm > 1e-10 else 1.0)


def leave_one_out(cells: DataFrame, samples: list[int], by: str = "chr", kind: str = "vanraden", ploidy: int = 2, tile: int = TILE) -> dict:
    """The relationship without the variants of each value of ``by``: products are made once, by value, and subtracted from their sum."""
    _checked(samples)
    rows = encoded(cells, kind, ploidy).persist()
    parts = _assembled(tiles(rows, samples, tile, by), len(samples), tile, by)
    norms = {r[by]: r["norm"] for r in _norm(rows, by).collect()}
    rows.unpersist()
    whole, norm = sum(parts.values()), sum(norms.values())
    return {c: (whole - k) / max(norm - norms[c], 1e-10) for c, k in parts.items()}


def zhang(cells: DataFrame, samples: list[int]) -> np.ndarray:
    """Centred products rescaled by the samples' inbreeding: floor and largest diagonal to the least relationship and the top."""
    own = Window.partitionBy("v_idx")
    filled = cells.withColumn("dosage", F.coalesce("dosage", F.avg("dosage").over(own)))
    filled = filled.withColumn("mean", F.avg("dosage").over(own)).where((F.col("mean") > 0) & (F.col("mean") < 2))
    het = {r["s_idx"]: r["h"] for r in filled.groupBy("s_idx").agg(F.avg(1 - F.abs(F.col("dosage") - 1)).alias("h")).collect()}
    if not het:
        return np.eye(len(samples))
    k, _ = gram(filled.select("v_idx", "s_idx", (F.col("dosage") - F.col("mean")).alias("x"), F.lit(0.0).alias("norm")), samples)
    top = 2 - min(het.values()) / 2
    low, high = k.min(), np.diag(k).max()
    if abs(high - low) < 1e-20:
        return np.eye(len(samples))
    k = top * (k - low) / (high - low)
    own = np.eye(len(k), dtype=bool)
    least = np.diag(k).min()
    if least < 1:
        k = np.where(own, (k - least + 1) * 2 / (top + 1 - least), k / least)
    most = k[~own].max(initial=0.0)
    return np.where(own, k, k * top / most) if most > top else k


def standardised(k: np.ndarray) -> np.ndarray:
    """Scaled so that the mean sample variance is one."""
    return k / ((np.trace(k) - k.mean() * len(k)) / (len(k) - 1))


def epistatic(additive: np.ndarray, dominance: np.ndarray) -> dict[str, np.ndarray]:
    return {"aa": additive * additive, "dd": dominance * dominance, "ad": additive * dominance}


def spectrum(k: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first and clamped, and eigenvectors."""
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], floor), vectors[:, order]


def components_for(values: np.ndarray, share: float = 0.995) -> int:
    """The first number of eigenvalues, largest first, that reach the share of their total."""
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)


def effective_tests(correlation: np.ndarray, share: float = 0.995) -> int:
    return components_for(spectrum(correlation)[0], share)
