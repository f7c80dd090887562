"""Vectorised scans over the UTF-8 bytes of many texts at once: words, hashes of spans.

Texts of a batch are laid end to end. The hash of a span of up to SHORT bytes is a difference of
prefix sums of byte * BASE**position modulo 2**64, brought to position 0 by the inverse power and
mixed with the length, so hashing costs a few passes over the bytes however many spans there are.
Such sums are no hash of long spans: texts that repeat in certain patterns agree in ever more low bits
the longer they are, and in all 64 from some thousand bytes on. As `identities`, longer spans get the
XXH3 of their bytes.

Defined results: no texts give empty arrays; an empty text has no words; equal spans have equal
hashes wherever they stand.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes up to which the worst pattern leaves over 40 bits that differ.
SHORT = 64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, at least; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**position before each position, one more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes for bucketing; long spans of certain patterns share one."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that stand for the spans."""
    out = span_hashes(prefix_sums(data), starts, ends)
    view = memoryview(data)
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(view[starts[k] : ends[k]], SHORT)
    return out


def batches(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together (a longer text is a range of its own)."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if len(texts) > first:
        yield first, len(texts)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, after which the worker gives freed memory back: it lives on between tasks."""

    def run(stream: Iterator) -> Iterator:
        yield from work(stream)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, end, texts) of ranges of a string column of about ``most`` bytes; only one range at a time is made Python text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and size + n > most:
            yield first, k, column.slice(first, k - first).to_pylist()
            first, size = k, 0
        size += n + 1
    if len(column) > first:
        yield first, len(column), column.slice(first).to_pylist()


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each followed by a line feed; starts of the texts and the end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return data, bounds


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space; the data ends in white space."""
    space = np.concatenate(([True], _SPACE[data]))
    change = np.flatnonzero(space[1:] != space[:-1])
    return change[0::2], change[1::2]
