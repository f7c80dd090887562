"""The copying model on longest matches: positional prefix arrays choose the samples that each one may copy from.

Sorting samples by their calls read backwards from a site puts the longest matches that end there side by
side, and moving to the next site is one stable sort by its calls. Each sample collects its neighbours at
every site, in both directions, weighs them by the lengths of their matches, and keeps the heaviest as
states of the copying model. Choosing takes samples x sites steps, the model samples x states x sites, where
`genetics_extra.copying_posterior` takes samples squared x sites; with all others as states both agree.

Defined cases: a missing call sorts as the site's rounded mean (0 for a site without calls) and matches by
it; ties in weight go to the smaller place; a panel of one sample gets the site means.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (samples x states x sites) of the model, or candidates of samples, worked on at once.
CELLS = 1_000_000
#: Samples of one packed row.
TILE = 1 << 16


def prefix_orders(calls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sites, samples) twice: the prefix order at each site, and where the match of each place with the one above it begins."""
    n, m = calls.shape
    orders, begins = np.empty((m, n), np.int32), np.empty((m, n), np.int32)
    order, begin = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for k in range(m):
        symbol = calls[order, k]
        moved, starts = [], []
        for v in np.unique(symbol):
            at = np.flatnonzero(symbol == v)
            # a match of two that become neighbours begins where the latest of those between them does
            starts.append(np.concatenate([np.array([k + 1], np.int32), _between(begin, at)]))
            moved.append(order[at])
        order, begin = np.concatenate(moved), np.concatenate(starts)
        orders[k], begins[k] = order, begin
    return orders, begins


def around(order: np.ndarray, begin: np.ndarray, at: np.ndarray, k: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 2 * near) twice: who stands around the places ``at`` in the order of site k, and the length of the match that ends there; -1 and 0 beyond the ends."""
    n = len(order)
    who, length = np.full((len(at), 2 * near), -1, np.int32), np.zeros((len(at), 2 * near), np.int32)
    up, down = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for j in range(1, min(near, n - 1) + 1):
        # matches with the j-th above and below begin at the latest begin on the way
        ok = at >= j
        up[ok] = np.maximum(up[ok], begin[at[ok] - j + 1])
        who[ok, j - 1], length[ok, j - 1] = order[at[ok] - j], np.maximum(k + 1 - up[ok], 0)
        ok = at < n - j
        down[ok] = np.maximum(down[ok], begin[at[ok] + j])
        who[ok, near + j - 1], length[ok, near + j - 1] = order[at[ok] + j], np.maximum(k + 1 - down[ok], 0)
    return who, length


def neighbours(calls: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For each site, sample and 2 * near places around it in the prefix order: (who, length of the match that ends at the site); -1 and 0 beyond the ends."""
    n, m = calls.shape
    who, length = np.empty((m, n, 2 * near), np.int32), np.empty((m, n, 2 * near), np.int32)
    for k, (order, begin) in enumerate(zip(*prefix_orders(calls), strict=True)):
        who[k, order], length[k, order] = around(order, begin, np.arange(n), k, near)
    return who, length


def _between(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Latest begin in (at[i], at[i + 1]] for each pair of following places."""
    if len(at) < 2:
        return np.zeros(0, begin.dtype)
    return np.maximum.reduceat(begin[: at[-1] + 1], at[:-1] + 1)


def chosen(calls: np.ndarray, states: int, near: int = 4) -> np.ndarray:
    """(samples, states): whom each sample may copy from, by its matches forwards and backwards, summed over sites in shares of the longest there; filled up by the smallest places."""
    n = len(calls)
    out = np.empty((n, min(states, n - 1)), np.int32)
    for rows, own in choices(calls, np.arange(n), states, near):
        out[rows] = own
    return out


def choices(calls: np.ndarray, targets: np.ndarray, states: int, near: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`chosen` of the targets, some at a time: beside the prefix orders of all samples only these are held."""
    n, m = calls.shape
    size = min(states, n - 1)
    step = max(1, CELLS // max(1, m * max(size, 4 * near)))
    if states >= n - 1:
        for a in range(0, len(targets), step):
            rows = targets[a : a + step]
            own = np.arange(n - 1)[None] + np.zeros((len(rows), 1), int)
            yield rows, own + (own >= rows[:, None])
        return
    # each site has a say of one for its longest match, so that a long stretch doesn't crowd out the others
    ways = [prefix_orders(calls), prefix_orders(calls[:, ::-1])]
    places = []
    for orders, _ in ways:
        place = np.empty_like(orders)
        for k in range(m):
            place[k, orders[k]] = np.arange(n, dtype=np.int32)
        places.append(place)
    for a in range(0, len(targets), step):
        rows = targets[a : a + step]
        found, shares = [], []
        for (orders, begins), place in zip(ways, places, strict=True):
            for k in range(m):
                who, length = around(orders[k], begins[k], place[k, rows], k, near)
                found.append(who)
                shares.append(length / np.maximum(length.max(axis=1, keepdims=True), 1))
        yield rows, _heaviest(rows, np.concatenate(found, axis=1), np.concatenate(shares, axis=1), states, n)


def _heaviest(rows: np.ndarray, who: np.ndarray, share: np.ndarray, states: int, n: int) -> np.ndarray:
    """The candidates of each row of largest summed share, ties to the smaller; filled up by the smallest places."""
    line = np.repeat(np.arange(len(rows)), who.shape[1])
    who, share = who.ravel(), share.ravel()
    keys, place = np.unique(line[who >= 0] * n + who[who >= 0], return_inverse=True)
    weight = np.bincount(place, share[who >= 0], minlength=len(keys))
    line, who = keys // n, keys % n
    order = np.lexsort((who, -weight, line))
    line, who = line[order], who[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    kept = rank < states
    line, who, rank = line[kept], who[kept], rank[kept]
    out = np.full((len(rows), states), -1)
    out[line, rank] = who
    for r in np.flatnonzero(out[:, -1] < 0):
        best = out[r][out[r] >= 0]
        rest = np.setdiff1d(np.arange(min(n, 2 * states + 2)), np.append(best, rows[r]))
        out[r] = np.concatenate([best, rest[: states - len(best)]])
    return out


def posterior(g: np.ndarray, states: int, near: int = 4, switch: float = 0.05, error: float = 0.02, ploidy: int = 2, rounds: int = 2) -> np.ndarray:
    """Expected dosages (rows samples, columns sites in order, NaN missing) where each sample is a mosaic of its ``states``.

    Holes break matches, so states are chosen again on calls that the round before has filled.
    """
    n = len(g)
    known = ~np.isnan(g)
    mean = np.where(known, g, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    filled = np.where(known, g, mean)
    targets = np.flatnonzero(~known.all(axis=1))
    if n < 2 or not len(targets):
        return filled
    guess = filled
    for _ in range(1 if states >= n - 1 else rounds):
        # the model copies known and mean calls; only the choice looks at what the round before has filled
        calls = np.rint(guess).astype(_whole(guess))
        guess = None
        guess = _copied(g, known, filled, choices(calls, targets, states, near), switch, error, ploidy)
    return guess


def _whole(x: np.ndarray) -> type:
    """A type that holds the rounded values."""
    return np.int8 if -127 < x.min(initial=0.0) and x.max(initial=0.0) < 127 else np.int64


def _copied(g: np.ndarray, known: np.ndarray, filled: np.ndarray, choice: Iterable[tuple[np.ndarray, np.ndarray]], switch: float, error: float, ploidy: int) -> np.ndarray:
    """The model of each target on those it may copy from, in steps of bounded size."""
    m, out = g.shape[1], g.copy()
    cost = np.log((1 - error) / error) / ploidy
    for rows, copied in choice:
        size = copied.shape[1]
        ref = filled[copied]  # (rows, states, sites)
        emit = np.where(known[rows][:, None], np.exp(-np.abs(ref - filled[rows][:, None]) * cost), 1.0)
        forward = np.empty_like(emit)
        f = emit[:, :, 0] / emit[:, :, 0].sum(axis=1, keepdims=True)
        forward[:, :, 0] = f
        for t in range(1, m):
            f = ((1 - switch) * f + switch / size) * emit[:, :, t]
            f = f / f.sum(axis=1, keepdims=True)
            forward[:, :, t] = f
        b = np.ones_like(f)
        for t in range(m - 1, -1, -1):
            if t < m - 1:
                e = emit[:, :, t + 1] * b
                b = (1 - switch) * e + switch * e.mean(axis=1, keepdims=True)
                b = b / b.sum(axis=1, keepdims=True)
            chance = forward[:, :, t] * b
            expected = (chance * ref[:, :, t]).sum(axis=1) / chance.sum(axis=1)
            out[rows, t] = np.where(known[rows, t], g[rows, t], expected)
    return out


def impute(cells: DataFrame, variants: DataFrame, states: int = 100, near: int = 4, window: int = 50_000) -> DataFrame:
    """(v_idx, s_idx, dosage) with missing calls filled, in windows of positions; a task holds one window of all samples, packed by variant."""
    placed = cells.join(variants.select("v_idx", "chr", "pos"), "v_idx").withColumn("block", F.floor(F.col("pos") / window))
    # a row has a tile of a variant's samples, so that rows pass to the task a few at a time
    cell = F.struct("s_idx", F.col("dosage").cast("double").alias("dosage"))
    packed = placed.groupBy("chr", "block", "pos", "v_idx", F.floor(F.col("s_idx") / TILE).alias("tile")).agg(F.array_sort(F.collect_list(cell)).alias("x"))
    packed = packed.select("chr", "block", "pos", "v_idx", "tile", F.col("x.s_idx").alias("s"), F.col("x.dosage").alias("d"))
    parts = 8 * cells.sparkSession.sparkContext.defaultParallelism  # few windows each
    dealt = packed.repartition(parts, "chr", "block").sortWithinPartitions("chr", "block", "pos", "v_idx", "tile")

    def done(rows: list[tuple[int, int, np.ndarray, np.ndarray]], tiles: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        who = np.concatenate([tiles[t] for t in sorted(tiles)])
        order = np.array(list(dict.fromkeys(v for v, *_ in rows)), np.int64)
        column = {v: k for k, v in enumerate(order.tolist())}
        g = np.full((len(who), len(order)), np.nan)
        for v, _, s, d in rows:
            g[np.searchsorted(who, s), column[v]] = d
        rows.clear()
        filled = posterior(g, states, near)
        step = max(1, (1 << 16) // len(order))
        for a in range(0, len(who), step):
            own = who[a : a + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(order, len(own))), pa.array(np.repeat(own, len(order))), pa.array(filled[a : a + step].ravel())], ["v_idx", "s_idx", "dosage"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, tiles = None, [], {}
        for batch in stream:
            for r in range(batch.num_rows):
                key = batch.column("chr")[r].as_py(), batch.column("block")[r].as_py()
                if key != now and rows:
                    yield from done(rows, tiles)
                    rows, tiles = [], {}
                now, t = key, batch.column("tile")[r].as_py()
                s = batch.column("s")[r].values.to_numpy()
                if t not in tiles:
                    tiles[t] = s.copy()
                # the samples are mostly those of the variant before: kept once
                same = np.array_equal(tiles[t], s)
                tiles[t] = tiles[t] if same else np.union1d(tiles[t], s)
                rows.append((batch.column("v_idx")[r].as_py(), t, tiles[t] if same else s.copy(), batch.column("d")[r].values.to_numpy(zero_copy_only=False).copy()))
        if rows:
            yield from done(rows, tiles)

    return dealt.mapInArrow(run, "v_idx long, s_idx long, dosage double")
