"""Matrix scans: a function of dosage columns applied to batches of variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells of the matrix that a task makes at once.
BATCH_CELLS = 4_000_000


def pack(cells: DataFrame) -> DataFrame:
    """(v_idx, s, d): the known calls of each variant as two arrays; persist it to scan the same calls again."""
    known = F.collect_list(F.when(F.col("dosage").isNotNull(), F.struct("s_idx", "dosage"))).alias("x")
    return cells.groupBy("v_idx").agg(known).select("v_idx", F.col("x.s_idx").alias("s"), F.col("x.dosage").alias("d"))


def _matrix(batch: pa.RecordBatch, order: np.ndarray) -> np.ndarray:
    """Samples by variants of a batch, missing calls at the variant's mean (0 without calls); samples outside ``order`` are left out."""
    s, d = batch.column("s"), batch.column("d")
    counts = np.diff(s.offsets.to_numpy())
    who, x = s.flatten().to_numpy(), d.flatten().to_numpy()
    column = np.repeat(np.arange(batch.num_rows), counts)
    row = np.searchsorted(order, who)
    inside = (row < len(order)) & (order[np.minimum(row, len(order) - 1)] == who) if len(order) else np.zeros(len(who), bool)
    row, column, x = row[inside], column[inside], x[inside]
    total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    np.add.at(total, column, x)
    np.add.at(n, column, 1)
    g = np.tile(np.where(n > 0, total / np.maximum(n, 1), 0.0), (len(order), 1))
    g[row, column] = x
    return g


def store(cells: DataFrame, samples: list[int], path: str) -> None:
    """Write cells of whole dosages as one byte for each of the samples in order (v_idx, g), 255 where there is no call: the form that scans of many variants read fastest."""
    order = np.array(sorted(samples))
    count = len(order)

    def bytes_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for k in range(batch.num_rows):
                row, who = np.full(count, 255, np.uint8), batch.column("s")[k].values.to_numpy()
                inside = np.isin(who, order)
                row[np.searchsorted(order, who[inside])] = np.rint(batch.column("d")[k].values.to_numpy()[inside]).astype(np.uint8)
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("v_idx"), pa.array(out, pa.binary())], ["v_idx", "g"])

    pack(cells).mapInArrow(bytes_of, "v_idx bigint, g binary").write.mode("overwrite").parquet(path)


def _dense(batch: pa.RecordBatch, count: int) -> np.ndarray:
    """Samples by variants of a batch that `store` wrote."""
    raw = np.frombuffer(b"".join(batch.column("g").to_pylist()), np.uint8).reshape(batch.num_rows, count)
    g = raw.astype(float)
    gone = raw == 255
    if gone.any():
        n = np.maximum((~gone).sum(axis=1), 1)
        mean = np.where(gone, 0.0, g).sum(axis=1) / n
        g = np.where(gone, mean[:, None], g)
    return g.T


def map_variants(cells: DataFrame, samples: list[int], work: Callable[[np.ndarray, Any], dict[str, np.ndarray]], state: Any, schema: str) -> DataFrame:
    """``work(G, state)`` on (samples x variants) blocks of cells (v_idx, s_idx, dosage), or of what `pack` or `store` made of them.

    Missing calls get the variant's mean. state is broadcast once; it holds what a null fit left,
    of a size in samples. Each row groups one variant's calls, so a task's memory is BATCH_CELLS
    cells, or one variant's. The result has v_idx and the columns that work returns.
    """
    order = np.array(sorted(samples))
    shared = cells.sparkSession.sparkContext.broadcast(state)
    stored = "g" in cells.columns
    packed = cells if stored or "s" in cells.columns else pack(cells)
    step = max(1, BATCH_CELLS // max(1, len(order)))

    names = [c.split()[0] for c in schema.split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                found = work(_dense(part, len(order)) if stored else _matrix(part, order), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("v_idx"), *(pa.array(found[n]) for n in names)], ["v_idx", *names])

    return packed.mapInArrow(run, f"v_idx long, {schema}")
