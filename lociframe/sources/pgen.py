"""Records of PLINK 2 genotype files.

A file of mode FIXED has two bits a call. One of mode VARIABLE has blocks of BLOCK variants; the
header gives each block's place, and for each of its variants a record type and length. A record
holds its calls in one of these ways: two bits each; one bit each for the two commonest calls, with
a list of the others; a list of the calls that differ from one common call; or a list of those that
differ from the last record of another way before it, whose calls may be swapped. A block begins with
a record that refers to none, so a range of variants needs at most the records from the last such one.
Dosages, where a record has them, follow the calls and the phase.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

FIXED, VARIABLE = 2, 16
BLOCK = 1 << 16
#: Entries of a list that share a first sample.
GROUP = 64
#: Copies of the alternate allele by two-bit code, and what a dosage counts as one copy.
COPIES = np.array([0.0, 1.0, 2.0, np.nan])
ONE_COPY = 16384


@dataclass(frozen=True)
class Header:
    mode: int
    variants: int
    samples: int
    control: int
    blocks: tuple[int, ...]


def two_bits(raw: np.ndarray, n: int) -> np.ndarray:
    """The first n two-bit codes of each row of bytes, lowest bits first."""
    return ((raw[..., None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(*raw.shape[:-1], -1)[..., :n]


def header(f: pa.NativeFile) -> Header:
    head = f.read_at(12, 0)
    if head[:2] != b"\x6c\x1b":
        raise ValueError("not a PLINK 2 file")
    if head[2] not in (FIXED, VARIABLE):
        raise ValueError(f"storage mode {head[2]} is not read")
    variants, samples, control = struct.unpack_from("<IIB", head, 3)
    blocks = ()
    if head[2] == VARIABLE:
        if control & 8:
            raise ValueError("this form of the index is not read")
        n = -(-variants // BLOCK)
        blocks = struct.unpack(f"<{n}Q", f.read_at(8 * n, 12))
    return Header(head[2], variants, samples, control, blocks)


def index(f: pa.NativeFile, head: Header, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Record types of a block's variants, and the places of the records and of the last one's end."""
    n = min(BLOCK, head.variants - block * BLOCK)
    wide, width = bool(head.control & 4), 1 + (head.control & 3)
    alleles, flags = head.control >> 4 & 3, head.control >> 6 == 3
    size = lambda n: (n if wide else (n + 1) // 2) + n * width + n * alleles + ((n + 7) // 8 if flags else 0)
    raw = np.frombuffer(f.read_at(size(n), 12 + 8 * len(head.blocks) + block * size(BLOCK)), np.uint8)
    used = n if wide else (n + 1) // 2
    kinds = raw[:n] if wide else np.stack([raw[:used] & 15, raw[:used] >> 4], axis=1).ravel()[:n]
    lengths = raw[used : used + n * width].reshape(n, width).astype(np.int64) @ (1 << (8 * np.arange(width)))
    return kinds, head.blocks[block] + np.concatenate(([0], np.cumsum(lengths)))


class _Record:
    """Reads one record from its start."""

    def __init__(self, data: bytes, samples: int):
        self.data, self.at, self.n = data, 0, samples
        self.id_bytes = max(1, (samples.bit_length() + 7) // 8)

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.data):
            raise ValueError("a record ends early")
        self.at += n
        return np.frombuffer(self.data, np.uint8, n, self.at - n)

    def numbers(self, n: int) -> np.ndarray:
        """Numbers in groups of seven bits, lowest first; the last group of each has its high bit clear."""
        rest = np.frombuffer(self.data, np.uint8, min(len(self.data) - self.at, 5 * n), self.at)
        last = np.flatnonzero(rest < 128)[:n]
        if len(last) < n:
            raise ValueError("a record ends early")
        begin = np.concatenate(([0], last[:-1] + 1)) if n else last
        self.at += int(last[-1]) + 1 if n else 0
        shifts = np.arange(last[-1] + 1 if n else 0) - np.repeat(begin, last - begin + 1)
        return np.add.reduceat((rest[: len(shifts)] & 127).astype(np.int64) << (7 * shifts), begin) if n else last

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.take((n + 7) // 8), bitorder="little")[:n].astype(bool)

    def codes(self, n: int) -> np.ndarray:
        return two_bits(self.take((n + 3) // 4), n)

    def listed(self, with_codes: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Samples of a list and their codes."""
        n = int(self.numbers(1)[0])
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        groups = -(-n // GROUP)
        firsts = self.take(groups * self.id_bytes).reshape(groups, self.id_bytes).astype(np.int64) @ (1 << (8 * np.arange(self.id_bytes)))
        self.take(groups - 1)  # bytes of the groups, for those who skip some
        codes = self.codes(n) if with_codes else np.zeros(0, np.uint8)
        head = np.arange(n) % GROUP == 0
        steps = np.zeros(n, np.int64)
        steps[~head] = self.numbers(n - groups)
        total = np.cumsum(steps)
        samples = total - np.repeat(total[head] - firsts, np.diff(np.append(np.flatnonzero(head), n)))
        if len(samples) and samples.max() >= self.n:
            raise ValueError("a list names a sample beyond the last")
        return samples, codes


def _calls(record: _Record, kind: int, base: np.ndarray | None) -> np.ndarray:
    """Two-bit codes of a record; base are those of the record it may refer to."""
    way = kind & 7
    if way == 0:
        return record.codes(record.n).copy()
    if way == 1:
        pair = int(record.take(1)[0])
        out = (pair // 4 + record.bits(record.n) * (pair & 3)).astype(np.uint8)
    elif way in (2, 3):
        if base is None:
            raise ValueError("a record refers to none before it")
        out = base.copy()
    elif way == 5:
        raise ValueError("this type of record is not defined")
    else:
        out = np.full(record.n, way & 3, np.uint8)
    samples, codes = record.listed()
    out[samples] = codes
    return np.array([2, 1, 0, 3], np.uint8)[out] if way == 3 else out


def _dosages(record: _Record, kind: int, codes: np.ndarray) -> np.ndarray:
    """Copies by the record's dosages where it has them, else by its calls; the calls have just been read."""
    out = COPIES[codes]
    if not kind & 0x60:
        return out
    if kind & 8:
        raise ValueError("dosages of variants of several alleles are not read")
    if kind & 16:
        hets = int((codes == 1).sum())
        told = record.bits(hets + 1)
        if told[0]:
            record.take((int(told[1:].sum()) + 7) // 8)
    way = kind & 0x60
    if way == 0x20:
        samples, _ = record.listed(False)
    elif way == 0x40:
        samples = np.arange(record.n)
    else:
        samples = np.flatnonzero(record.bits(record.n))
    values = record.take(2 * len(samples)).view("<u2").astype(float)
    known = values != 65535
    out[samples[known]] = values[known] / ONE_COPY
    return out


def records(f: pa.NativeFile, head: Header, first: int, count: int, dosages: bool = False) -> Iterator[np.ndarray]:
    """Dosages of ``count`` variants from ``first`` on, which lie in one block."""
    if head.mode == FIXED:
        stride = (head.samples + 3) // 4
        step = max(1, (1 << 20) // max(1, stride))
        for v in range(first, first + count, step):
            n = min(step, first + count - v)
            yield from COPIES[two_bits(np.frombuffer(f.read_at(n * stride, 12 + v * stride), np.uint8).reshape(n, stride), head.samples)]
        return
    block, start = divmod(first, BLOCK)
    kinds, places = index(f, head, block)
    refers = (kinds & 6) == 2
    own = np.flatnonzero(~refers[: start + 1])
    if not len(own):
        raise ValueError("a block begins with a record that refers to another")
    base = None
    for k in [*([int(own[-1])] if own[-1] < start else []), *range(start, start + count)]:
        record = _Record(f.read_at(int(places[k + 1] - places[k]), int(places[k])), head.samples)
        codes = _calls(record, int(kinds[k]), base)
        if not refers[k]:
            base = codes
        if k >= start:
            yield _dosages(record, int(kinds[k]), codes) if dosages else COPIES[codes]
