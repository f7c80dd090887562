"""Token counts of documents in flat token files, by a scan for separators.

A token file is a stream of fixed-width ids in which a separator ends each document; no index
says where. It is read in blocks. A vectorised comparison finds the separators of a block; a
prefix scan over the blocks' sums (tokens, separators, place of the last separator) then says
where each block begins in its file, how many documents ended before it, and where the document
that is open at its start began. So each document's start and length follow from its own block.

Scale: blocks are read once and reduced to the places of their separators. The prefix scan sees
one small row for each block. Token files written here have a sidecar of keys in file order.

Defined results: a document of no tokens counts 0; tokens after a file's last separator are one
open document (ended is false); a null text is empty; an empty table gives an empty result; an id
that the width can't hold raises an error, so nothing wraps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import written
from .tokens import Encoder

BLOCK_TOKENS = 1 << 16
SLICE_BYTES = 1 << 21


def width_for(tokenizer: str, separator: int) -> int:
    """Bytes an id needs: 2, or 4 for vocabularies above 65,536."""
    return 2 if max(separator, Encoder.of(tokenizer).largest) < 1 << 16 else 4


def token_files(docs: DataFrame, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text", width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of ``docs``, one for each partition, in blocks: (file, block, data, first, keys).

    Rows with data are blocks of the file; rows with keys are its sidecar: the keys of the
    documents from number ``first`` on. Strings of special tokens in a text are ordinary text.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    if max(separator, Encoder.of(tokenizer).largest) >= 1 << 8 * width:
        raise ValueError(f"ids of {tokenizer} or the separator {separator} need more than {width} bytes")

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block, first, rest = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0, b""
        size = block_tokens * width

        def row(key_type, data=None, keys=None):
            arrays = [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(key_type))]
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "data", "first", "keys"])

        key_type = pa.int64()
        for batch in stream:
            key_type = batch.column("key").type
            for a, b, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                ids = encoder.encode(texts, ordinary=True)
                end = np.array([separator], np.uint32)
                rest += np.concatenate([x for own in ids for x in (own, end)]).astype(f"<u{width}").tobytes()
                yield row(key_type, keys=batch.column("key").slice(a, b - a).to_pylist())
                first += b - a
                whole = len(rest) // size * size
                for at in range(0, whole, size):
                    yield row(key_type, data=rest[at : at + size])
                    block += 1
                rest = rest[whole:]
        if rest:
            yield row(key_type, data=rest)

    return source.mapInArrow(bytescan.tidy(write), f"file int, block bigint, data binary, first bigint, keys array<{kind}>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, data) of binary token files under ``path``. A file of less than 2 GB is one task, which holds it once and passes on a block at a time; larger files should be written in parts."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    size = block_tokens * width

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                data = memoryview(batch.column("content")[k].as_buffer())
                for block in range(max(1, -(-len(data) // size))):
                    piece = pa.array([bytes(data[block * size : (block + 1) * size])], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("file").slice(k, 1), pa.array([block], pa.int64()), piece], ["file", "block", "data"])

    return files.mapInArrow(bytescan.tidy(cut), "file string, block bigint, data binary")


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """Per document of the files in ``blocks`` (file, block, data): file, nth, start, n_tokens, ended."""
    kind = blocks.schema["file"].dataType.simpleString()

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data = [np.frombuffer(x or b"", f"<u{width}") for x in batch.column("data").to_pylist()]
            ends = [np.flatnonzero(x == separator).astype(np.int32) for x in data]
            columns = [batch.column("file"), batch.column("block"), pa.array(map(len, data), pa.int64()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "ends"])

    scanned = written(blocks.select("file", "block", "data").mapInArrow(bytescan.tidy(scan), f"file {kind}, block bigint, n bigint, ends array<int>"), "token-ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.select("file", "block", "n", F.size("ends").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    sums = sums.withColumn("tokens", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("docs", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    sums = sums.withColumn("open_at", F.coalesce(F.max(F.col("tokens") + F.col("last")).over(earlier) + 1, F.lit(0)))
    placed = scanned.select("file", "block", "ends").join(sums, ["file", "block"])
    found = placed.select("file", "tokens", "docs", "open_at", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open_at")).otherwise(F.col("tokens") + F.get("ends", F.col("i") - 1) + 1)
    ended = found.select("file", (F.col("docs") + F.col("i")).alias("nth"), start.alias("start"), (F.col("tokens") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = sums.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("nth"), F.coalesce(F.max(F.col("tokens") + F.col("last")) + 1, F.lit(0)).alias("start"))
    left = whole.where(F.col("n") > F.col("start")).select("file", "nth", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(left)


def document_tokens(docs: DataFrame, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, file, nth, start, n_tokens, counted in token files written for it."""
    width = width_for(tokenizer, separator)
    files = written(token_files(docs, tokenizer, separator, key, text, width), "token-files")
    found = count_tokens(files.where(F.col("data").isNotNull()), separator, width)
    keys = files.where(F.col("keys").isNotNull()).select("file", "first", F.posexplode("keys").alias("i", "key"))
    keys = keys.select("file", (F.col("first") + F.col("i")).alias("nth"), "key")
    return keys.join(found, ["file", "nth"]).select("key", "file", "nth", "start", "n_tokens")
