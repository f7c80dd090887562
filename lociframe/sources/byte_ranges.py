"""Binary genotype files as a Spark data source that reads byte ranges.

The driver plans (offset, length) ranges from a file's header or index; each range is a task that
opens the file where it is (pyarrow's file systems: local paths and the URIs they know), seeks and
decodes a few variants at a time. So files of any size are read by as many tasks as they have
ranges, no task holds more than a range, and a lost task reads its range again.

Rows are (v_idx, d) with one dosage for each sample, and for BGEN also (snp, chr, pos, a1, a2); only
the columns of the schema that is asked for are made, so probabilities stay packed where only
variants are wanted. The options first and last bound v_idx before any range is planned.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import pgen

NAME = "genotype_ranges"
#: Bytes of a range, about.
RANGE_BYTES = 1 << 25
#: Dosages that a task passes on at once.
BATCH_VALUES = 1 << 20
CALLS = "v_idx bigint, d array<double>"
VARIANTS = "v_idx bigint, snp string, chr string, pos bigint, a1 string, a2 string"
#: Copies of the counted allele by two-bit code, NaN where a call is missing.
BED_CODES = np.array([2.0, np.nan, 1.0, 0.0])


def open_input(path: str) -> pa.NativeFile:
    """A file that can be read from any place, in any store that pyarrow knows."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


@dataclass
class Range(InputPartition):
    """Variants first .. first + count - 1, in bytes start .. end of the file (PGEN: part of a block)."""

    first: int
    count: int
    start: int = 0
    end: int = 0


def rows_of(first: int, dosages: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Variants numbered from first with a row of dosages each; NaN is null."""
    n, width = dosages.shape
    ends = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    columns = {"v_idx": pa.array(np.arange(first, first + n)), "d": pa.ListArray.from_arrays(ends, pa.array(dosages.ravel(), pa.float64(), from_pandas=True))}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"], names
        self.samples = int(options.get("samples", 0))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 1 << 62))
        self.dosages = options.get("dosages", "false") == "true"
        self.step = max(1, BATCH_VALUES // max(1, self.samples))

    def _cut(self, first: int, end: int, each: int) -> list[Range]:
        """Ranges of ``each`` variants of first .. end - 1 within the bounds asked for."""
        first, end = max(first, self.low), min(end, self.high + 1)
        return [Range(v, min(each, end - v)) for v in range(first, end, each)]


class BedReader(_Reader):
    """PLINK 1, variant-major: two bits a call, rows of whole bytes after three bytes of magic."""

    def partitions(self) -> list[Range]:
        with open_input(self.path) as f:
            if f.read(3) != b"\x6c\x1b\x01":
                raise ValueError(f"{self.path} is not a variant-major PLINK file")
            n, rest = divmod(f.size() - 3, self.stride)
        if rest:
            raise ValueError(f"{self.path} does not hold whole rows of {self.samples} samples")
        return self._cut(0, n, max(1, self.range_bytes // self.stride))

    @property
    def stride(self) -> int:
        return max(1, (self.samples + 3) // 4)

    def read(self, at: Range) -> Iterator[pa.RecordBatch]:
        with open_input(self.path) as f:
            f.seek(3 + at.first * self.stride)
            for v in range(at.first, at.first + at.count, self.step):
                n = min(self.step, at.first + at.count - v)
                raw = np.frombuffer(f.read(n * self.stride), np.uint8).reshape(n, self.stride)
                yield rows_of(v, BED_CODES[pgen.two_bits(raw, self.samples)], self.names)


class PgenReader(_Reader):
    """PLINK 2: fixed-width calls (mode 2), or records of any width (mode 16), found by the index of their block."""

    def partitions(self) -> list[Range]:
        with open_input(self.path) as f:
            head = pgen.header(f)
            if head.samples != self.samples:
                raise ValueError(f"{self.path} has {head.samples} samples, not {self.samples}")
            if head.mode == pgen.FIXED:
                return self._cut(0, head.variants, max(1, self.range_bytes // ((self.samples + 3) // 4)))
            ends = [*head.blocks[1:], f.size()]
            out = []
            for k, (start, end) in enumerate(zip(head.blocks, ends, strict=True)):
                first = k * pgen.BLOCK
                own = min(pgen.BLOCK, head.variants - first)
                out += self._cut(first, first + own, max(1, -(-own // max(1, -(-(end - start) // self.range_bytes)))))
            return out

    def read(self, at: Range) -> Iterator[pa.RecordBatch]:
        with open_input(self.path) as f:
            head, rows, first = pgen.header(f), [], at.first
            for d in pgen.records(f, head, at.first, at.count, self.dosages):
                rows.append(d)
                if len(rows) == self.step:
                    yield rows_of(first, np.stack(rows), self.names)
                    first, rows = first + len(rows), []
            if rows:
                yield rows_of(first, np.stack(rows), self.names)


@dataclass(frozen=True)
class BgenHead:
    begin: int
    variants: int
    samples: int
    compression: int
    layout: int


def bgen_header(path: str) -> tuple[BgenHead, list[str]]:
    """What the header of a BGEN file says, and the samples' names where it has them."""
    with open_input(path) as f:
        offset, length, variants, n = struct.unpack("<IIII", f.read_at(16, 0))
        flags = struct.unpack("<I", f.read_at(4, length))[0]
        names = [f"sample_{k}" for k in range(n)]
        if flags >> 31:
            data, at = f.read_at(offset - length, 4 + length), 8
            for k in range(n):
                size = struct.unpack_from("<H", data, at)[0]
                names[k], at = data[at + 2 : at + 2 + size].decode(), at + 2 + size
    return BgenHead(offset + 4, variants, n, flags & 3, flags >> 2 & 15), names


def bgen_variant(data: memoryview, at: int, head: BgenHead) -> tuple[dict, int, int]:
    """(fields, place of its probabilities, end) of the variant at a place; struct.error or IndexError where the data end before the probabilities do."""
    if head.layout == 1:
        at += 4
    texts = []
    for _ in range(3):
        size = struct.unpack_from("<H", data, at)[0]
        texts.append(bytes(data[at + 2 : at + 2 + size]))
        at += 2 + size
    pos = struct.unpack_from("<I", data, at)[0]
    alleles = struct.unpack_from("<H", data, at + 4)[0] if head.layout == 2 else 2
    at += 6 if head.layout == 2 else 4
    letters = []
    for _ in range(alleles):
        size = struct.unpack_from("<I", data, at)[0]
        letters.append(bytes(data[at + 4 : at + 4 + size]))
        at += 4 + size
    told = head.layout == 2 or head.compression
    size = struct.unpack_from("<I", data, at)[0] if told else 6 * head.samples
    start = at + (4 if told else 0)
    _, rs, chrom = (t.decode() for t in texts)
    fields = {"snp": rs or texts[0].decode() or f"{chrom}:{pos}", "chr": chrom, "pos": pos, "a1": letters[1].decode() if alleles > 1 else None, "a2": letters[0].decode()}
    return fields, start + (4 if head.layout == 2 and head.compression else 0), start + size


class BgenReader(_Reader):
    """BGEN: ranges of whole variants from a .bgi index beside a local file, or by going from header to header once."""

    def partitions(self) -> list[Range]:
        head, _ = bgen_header(self.path)
        index = f"{self.path}.bgi"
        found = self._indexed(index) if Path(index).exists() else self._walked(head)
        return [r for r in found if r.first <= self.high and r.first + r.count > self.low]

    def _indexed(self, index: str) -> list[Range]:
        with sqlite3.connect(index) as con:
            rows = con.execute(
                "SELECT count(*), min(file_start_position), max(file_start_position + size_in_bytes) FROM Variant "
                "GROUP BY (file_start_position - (SELECT min(file_start_position) FROM Variant)) / ? ORDER BY 2", (self.range_bytes,)
            ).fetchall()
        out, first = [], 0
        for n, start, end in rows:
            out.append(Range(first, n, start, end))
            first += n
        return out

    def _walked(self, head: BgenHead) -> list[Range]:
        out, first, v, at = [], 0, 0, head.begin
        start = at
        with open_input(self.path) as f:
            size = f.size()
            while at < size:
                peek, end = 1 << 12, None
                while end is None:
                    data = f.read_at(min(peek, size - at), at)
                    try:
                        _, _, end = bgen_variant(memoryview(data), 0, head)
                    except (struct.error, IndexError):
                        if len(data) < peek:
                            raise ValueError(f"{self.path} ends within a variant") from None
                        peek *= 4
                at, v = at + end, v + 1
                if at - start >= self.range_bytes or at >= size:
                    out.append(Range(first, v - first, start, at))
                    first, start = v, at
        return out

    def read(self, at: Range) -> Iterator[pa.RecordBatch]:
        from .readers import bgen_dosages, zstandard

        head, _ = bgen_header(self.path)
        step = self.step if "d" in self.names else 1 << 12
        with open_input(self.path) as f:
            data = memoryview(f.read_at(at.end - at.start, at.start))
        place, v, held = 0, at.first, []

        def told() -> pa.RecordBatch:
            columns = {"v_idx": pa.array([r["v_idx"] for r in held], pa.int64())}
            for c in ("snp", "chr", "a1", "a2"):
                columns[c] = pa.array([r[c] for r in held], pa.string())
            columns["pos"] = pa.array([r["pos"] for r in held], pa.int64())
            if "d" in self.names:
                columns["d"] = rows_of(0, np.stack([r["d"] for r in held]), ["d"]).column("d")
            return pa.RecordBatch.from_arrays([columns[c] for c in self.names], self.names)

        while place < len(data):
            fields, start, end = bgen_variant(data, place, head)
            if self.low <= v <= self.high:
                if "d" in self.names:
                    block = bytes(data[start:end])
                    block = zlib.decompress(block) if head.compression == 1 else zstandard().decompress(block, 1 << 31) if head.compression == 2 else block
                    fields["d"] = bgen_dosages(block, head.samples, head.layout)
                held.append(fields | {"v_idx": v})
                if len(held) == step:
                    yield told()
                    held.clear()
            place, v = end, v + 1
        if held:
            yield told()


class GenotypeRanges(DataSource):
    """Options: path, kind (bed, pgen, bgen), samples, and range_bytes, first, last, dosages where wanted."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CALLS

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = {"bed": BedReader, "pgen": PgenReader, "bgen": BgenReader}[self.options["kind"]]
        return kind(dict(self.options), schema.names)


def read(spark: SparkSession, path: str, kind: str, samples: int, schema: str = CALLS, between: tuple[int, int] | None = None, range_bytes: int | None = None, dosages: bool = False) -> DataFrame:
    """Rows of ``schema`` of a binary genotype file, optionally of the variants ``between`` two numbers, both included."""
    spark.dataSource.register(GenotypeRanges)
    options = {"path": path, "kind": kind, "samples": str(samples), "dosages": str(dosages).lower()}
    if between:
        options |= {"first": str(between[0]), "last": str(between[1])}
    if range_bytes:
        options["range_bytes"] = str(range_bytes)
    return spark.read.format(NAME).schema(schema).options(**options).load()
