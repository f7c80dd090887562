"""Hard negatives for contrastive training: a Voronoi-partitioned kNN join on inner products.

A vector x is augmented by sqrt(M^2 - |x|^2) (M the largest norm), an anchor q by 0. Then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours and the
triangle inequality holds. Vectors belong to the cell of their nearest pivot; anchors are grouped by
neighbouring cells. Each anchor has a range of distances that can still serve it: a group asks a cell
only for vectors whose distance to the pivot can fall into such a range (triangle inequality, and the
half space between pivots), and only these are replicated to the group.

Two joins, each in two rounds (the group's own cells first, whose results narrow the ranges, then the
others): the first finds each anchor's nearest rows of its label, the positives; the second, for each
positive, the nearest rows of other labels whose score lies within a share of the positive's.
Scores are whole numbers and are computed exactly; distances only prune, with room for rounding.

Scale: pivots are a sample of MOST_PIVOTS rows at most (fewer for wide vectors), so only they and
counts by cell pass the driver; all rows are joined. Cells are dealt into chunks of CHUNK_ROWS by hash,
groups hold GROUP anchors at most, and a group's candidates are dealt into slices, so a cell, a label
or a vector that holds a third of all rows is spread. A task holds one group's anchors and their best
rows so far, and streams the candidates. Where distances do not separate (many dimensions without
clusters) nothing can be pruned and each group meets all rows: the work of any exact join.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component take no
part; repeated ids count once, by the smallest (label, vector); a shorter vector ends in zeros; with
fewer rows than asked for all are returned; ties go to the smaller id; an empty table gives an empty
result; only the named columns are read. A vector whose whole components have squares that add up to
2**53 or more is an error, since scores would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import discard, written

#: Pivots: one for CELL_ROWS rows, at most MOST_PIVOTS, and PIVOT_VALUES numbers together.
CELL_ROWS = 1024
MOST_PIVOTS = 1024
PIVOT_VALUES = 1 << 22
CHUNK_ROWS = 4096
#: Anchors of a group at most; few anchors still make GROUPS groups.
GROUP = 1024
GROUPS = 16
#: Rows that one task compares with a group, and slices a group has at least.
SLICE_ROWS = 1 << 16
LEAST_SLICES = 8
#: Pairs of rows whose scores are held at once.
STEP = 1 << 19
#: Below this square of a norm all scores are exact in floating point.
LARGEST = float(1 << 53)
#: Share by which rounding may move a distance.
ROOM = 1e-6


@dataclass
class Space:
    """What all tasks know: width of vectors, largest square of a norm, augmented pivots."""

    width: int
    most: float
    pivots: np.ndarray

    def last(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (rows * rows).sum(axis=1)))

    def to_pivots(self, rows: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """Distances of augmented rows to the pivots."""
        own, ends = self.pivots[:, :-1], self.pivots[:, -1]
        square = (rows * rows).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None] - 2 * rows @ own.T
        return np.sqrt(np.maximum(0.0, square + (np.reshape(last, (-1, 1)) - ends[None]) ** 2))


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", factor: int = 256) -> DataFrame:
    """(id, label, v): whole components floor(factor * x) of the rows that take part, one row an id."""
    label = F.col(label) if isinstance(label, str) else label
    own = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    own = own.select("id", "label", F.transform("x", lambda c: F.floor(F.lit(float(factor)) * c).cast("double")).alias("v"))
    return own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("of")).select("id", "of.label", "of.v")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole components from their bytes; `_placed` picks their size."""
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, width))
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(raw[0]) // width]
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), width).astype(float)


def _space(rows: DataFrame) -> Space | None:
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    n, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    if most >= LARGEST:
        raise ValueError(f"vectors are too large: a square of a norm is {most:.3g}")
    width = max(1, width)
    count = max(1, min(MOST_PIVOTS, PIVOT_VALUES // width, -(-n // CELL_ROWS)))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(count).select("v").toArrow().column("v")
    pivots = np.unique(_matrix(drawn, width), axis=0)
    last = np.sqrt(np.maximum(0.0, most - (pivots * pivots).sum(axis=1)))
    # the order in which groups are cut: each pivot is followed by the nearest one that is left
    order, left = [0], set(range(1, len(pivots)))
    full = np.column_stack([pivots, last])
    while left:
        rest = np.array(sorted(left))
        order.append(int(rest[((full[rest] - full[order[-1]]) ** 2).sum(axis=1).argmin()]))
        left.discard(order[-1])
    return Space(width, float(most), full[order])


def _placed(rows: DataFrame, space: Space, is_anchor: Column) -> DataFrame:
    """(id, label, v, cell, away, home, is_anchor): nearest pivot of the row and distance to it, nearest pivot of the row as an anchor."""
    kind = next(k for k in (np.int8, np.int16, np.int32) if space.most <= float(np.iinfo(k).max) ** 2)

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                own = _matrix(part.column("v"), space.width)
                far = space.to_pivots(own, space.last(own))
                cell = far.argmin(axis=1)
                home = space.to_pivots(own, 0.0).argmin(axis=1)
                packed = pa.array([x.tobytes() for x in own.astype(kind)], pa.binary())
                columns = [part.column("id"), part.column("label"), packed, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), pa.array(home.astype(np.int32)), part.column("is_anchor")]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "cell", "away", "home", "is_anchor"])

    flagged = rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
    return flagged.mapInArrow(bytescan.tidy(place), "id bigint, label bigint, v binary, cell int, away double, home int, is_anchor boolean")


def _grouped(rows: DataFrame, space: Space) -> DataFrame:
    """Anchors with their group: neighbouring cells together, a full cell in parts; at most GROUP or so in one."""
    anchors = rows.where("is_anchor")
    counts = np.zeros(len(space.pivots), np.int64)
    for cell, n in anchors.groupBy("home").agg(F.count("*")).collect():  # a row for each pivot at most
        counts[cell] = n
    most = max(1, min(GROUP, -(-int(counts.sum()) // GROUPS)))
    first = np.zeros(len(counts), np.int64)
    parts = np.maximum(1, -(-counts // most))
    number, held = 0, 0
    for k, n in enumerate(counts.tolist()):
        if held and held + n > most:
            number, held = number + 1, 0
        first[k] = number
        held += n
        if parts[k] > 1:
            number, held = number + int(parts[k]), 0
    table = F.lit(",".join(map(str, first.tolist()))), F.lit(",".join(map(str, parts.tolist())))
    at = [F.get(F.split(t, ",").cast("array<int>"), F.col("home")) for t in table]
    return anchors.withColumn("grp", (at[0] + F.pmod(F.xxhash64("id", F.lit(5)), at[1])).cast("int")).drop("cell", "away", "is_anchor")


def _asked(anchors: DataFrame, space: Space, own_cells: bool) -> DataFrame:
    """(grp, cell, low, high): what each group asks of its own cells, or of the others.

    ``anchors`` has least and most, the scores that can still serve it (null: any).
    """

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = len(space.pivots)
        group, cells = -1, np.zeros(pivots, bool)
        low, high = np.full(pivots, np.inf), np.full(pivots, -np.inf)

        def told() -> pa.RecordBatch:
            keep = np.flatnonzero(cells if own_cells else ~cells & (low <= high))
            ends = (np.zeros(len(keep)), np.full(len(keep), np.inf)) if own_cells else (low[keep], high[keep])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), group, np.int32)), pa.array(keep.astype(np.int32)), *map(pa.array, ends)], ["grp", "cell", "low", "high"])

        for batch in stream:
            numbers = batch.column("grp").to_numpy()
            for a in range(0, len(numbers), 512):
                part = batch.slice(a, 512)
                own = _unpack(part.column("v"), space.width)
                to = space.to_pivots(own, 0.0)
                square = (own * own).sum(axis=1) + space.most
                least = part.column("least").to_numpy(zero_copy_only=False)
                most = part.column("most").to_numpy(zero_copy_only=False)
                far = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, square - 2 * least)))
                near = np.where(np.isnan(most), 0.0, np.sqrt(np.maximum(0.0, square - 2 * most)))
                room = ROOM * (1 + np.sqrt(square))
                home = part.column("home").to_numpy()
                own_far = to[np.arange(len(to)), home]
                homes, at_home = np.unique(home, return_inverse=True)
                apart = np.stack([np.sqrt(((space.pivots - space.pivots[h]) ** 2).sum(axis=1)) for h in homes])[at_home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    half = np.where(apart > 0, (to**2 - own_far[:, None] ** 2) / (2 * apart), 0.0)
                open_ = (half <= (far + room)[:, None]) & (near <= far + room)[:, None]
                begin = np.where(open_, np.maximum(to - (far + room)[:, None], (near - room)[:, None] - to), np.inf)
                end = np.where(open_, to + (far + room)[:, None], -np.inf)
                for g in np.unique(numbers[a : a + 512]):
                    if g != group:
                        if group >= 0:
                            yield told()
                        group, cells = g, np.zeros(pivots, bool)
                        low, high = np.full(pivots, np.inf), np.full(pivots, -np.inf)
                    at = numbers[a : a + 512] == g
                    cells[home[at]] = True
                    low, high = np.minimum(low, begin[at].min(axis=0)), np.maximum(high, end[at].max(axis=0))
        if group >= 0:
            yield told()

    rows = anchors.select("grp", "home", "v", "least", "most").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(bytescan.tidy(ask), "grp int, cell int, low double, high double")


class Best:
    """The best rows for each place (anchor, window) so far."""

    def __init__(self, places: int, k: int):
        self.k, self.floor = k, np.full(places, -np.inf)
        self.place, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.more.append((place, score, ids))
        self.held += len(place)
        if self.held > max(STEP, 2 * len(self.place)):
            self.cut()

    def cut(self) -> None:
        place, score, ids = (np.concatenate([x, *y]) for x, y in zip((self.place, self.score, self.id), zip(*self.more) if self.more else ((), (), ()), strict=True))
        self.more, self.held = [], 0
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        full = rank == self.k - 1
        self.floor[place[full]] = score[full]
        keep = rank < self.k
        self.place, self.score, self.id = place[keep], score[keep], ids[keep]


def _joined(rows: DataFrame, anchors: DataFrame, asked: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): the k best rows of every slice for each anchor and window of scores.

    ``anchors`` (grp, id, label, v, lows, highs): a window takes scores from its low to its high.
    """
    chunks = rows.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    counted = rows.groupBy("cell").agg(F.count("*").alias("rows"))
    asked = written(asked, "negatives-asked")
    slices = asked.join(counted, "cell").groupBy("grp").agg(F.greatest(F.lit(LEAST_SLICES), F.ceil(F.sum("rows") / SLICE_ROWS)).cast("int").alias("slices"))
    wanted = asked.join(slices, "grp").join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    chunked = rows.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
    slice_ = F.pmod(F.xxhash64("id", F.lit(29)), F.col("slices")).cast("int").alias("slice")
    none = F.lit(None).cast("array<bigint>")
    offered = chunked.join(wanted, ["cell", "chunk"]).where("away between low and high").select("grp", slice_, F.lit(1).alias("role"), "id", "label", "v", none.alias("lows"), none.alias("highs"))
    held = anchors.join(slices, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), "id", "label", "v", "lows", "highs")
    dealt = held.unionByName(offered).repartition("grp", "slice").sortWithinPartitions("grp", "slice", "role")

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, own = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            if own is not None:
                best: Best = own["best"]
                best.cut()
                columns = [own["ids"][best.place // own["windows"]], (best.place % own["windows"]).astype(np.int32), best.id, best.score.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor", "window", "id", "score"])

        def ready(batches: list[pa.RecordBatch]) -> dict:
            whole = pa.Table.from_batches(batches)
            ids = whole.column("id").to_numpy()
            lows, highs = (_matrix(whole.column(c), max(map(len, whole.column("lows")), default=1)) for c in ("lows", "highs"))
            sizes = np.array([len(x) for x in whole.column("lows")])
            closed = np.arange(lows.shape[1])[None] >= sizes[:, None]
            lows[closed], highs[closed] = np.inf, -np.inf
            return {"ids": ids, "labels": whole.column("label").to_numpy(), "v": _unpack(whole.column("v"), space.width), "lows": lows, "highs": highs, "windows": lows.shape[1], "best": Best(lows.size, k)}

        for batch in stream:
            at = np.stack([batch.column(c).to_numpy() for c in ("grp", "slice", "role")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *number, role = at[a].tolist()
                if number != unit:
                    yield from told()
                    unit, parts, own = number, [], None
                if role == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                own = own or ready(parts)
                step = max(1, STEP // len(own["ids"]))
                for s in range(a, b, step):
                    part = batch.slice(s, min(step, b - s))
                    x, ids, labels = _unpack(part.column("v"), space.width), part.column("id").to_numpy(), part.column("label").to_numpy()
                    score = x @ own["v"].T
                    fits = (labels[:, None] == own["labels"][None]) == same
                    if same:
                        fits &= ids[:, None] != own["ids"][None]
                    for w in range(own["windows"]):
                        floor = np.maximum(own["lows"][:, w], own["best"].floor[w :: own["windows"]])
                        r, c = np.nonzero(fits & (score >= floor[None]) & (score <= own["highs"][:, w][None]))
                        if len(r):
                            own["best"].add(c * own["windows"] + w, score[r, c], ids[r])
        yield from told()

    return dealt.mapInArrow(bytescan.tidy(join), "anchor bigint, window int, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _rounds(rows: DataFrame, anchors: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """(anchor, window, rank, id, score) over all cells; ``anchors`` has arrays lows and highs of whole scores."""
    ends = anchors.withColumns({"least": F.array_min("lows").cast("double"), "most": F.array_max("highs").cast("double")})
    near = written(_ranked(_joined(rows, anchors, _asked(ends, space, True), space, k, same), k), "negatives-near")
    # a window that has k rows takes nothing below the last of them
    kth = near.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # as many as windows
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("kth", w)))
    narrow = anchors.join(kth, F.col("id") == F.col("anchor"), "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised)).drop("kth", "anchor")
    narrow = written(narrow, "negatives-anchors")
    ends = narrow.withColumns({"least": F.array_min("lows").cast("double"), "most": F.array_max("highs").cast("double")})
    far = _joined(rows, narrow, _asked(ends, space, False), space, k, same)
    done = written(_ranked(near.drop("rank").unionByName(far), k), "negatives-found")
    discard(near, narrow)
    return done


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, v).

    A negative's score is from ``low`` to ``high`` hundredths of the positive's.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = written(rows, "negatives-vectors")
    space = _space(rows)
    if space is None:
        discard(rows)
        return rows.sparkSession.createDataFrame([], schema)
    placed = written(_placed(rows, space, is_anchor), "negatives-placed")
    anchors = written(_grouped(placed, space), "negatives-groups")
    open_ = F.array(F.lit(-(1 << 53)).cast("long")), F.array(F.lit(1 << 53).cast("long"))
    best = _rounds(placed, anchors.withColumns({"lows": open_[0], "highs": open_[1]}), space, positives, True)
    # windows are numbered by the positive's rank; a negative score of the positive leaves none
    pairs = best.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("own"))  # as many as positives
    lows = F.transform("own", lambda p: F.ceil((p["positive_score"] * low).cast("decimal(38,0)") / 100).cast("long"))
    highs = F.transform("own", lambda p: F.floor((p["positive_score"] * high).cast("decimal(38,0)") / 100).cast("long"))
    asking = anchors.join(own, F.col("id") == F.col("anchor")).withColumns({"lows": lows, "highs": highs}).drop("own", "anchor")
    asking = written(asking, "negatives-asking")
    found = _rounds(placed, asking, space, negatives, False)
    named = found.select(F.col("anchor").alias("anchor_id"), (F.col("window") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = named.join(pairs.withColumnRenamed("anchor", "anchor_id"), ["anchor_id", "nth"])
    discard(rows, placed, anchors, asking)
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
