"""Sets of hashed word shingles of many texts, and SuperMinHash signatures of the sets.

Defined results: a null text is empty and has the empty set, whose signature is open in all slots;
equal texts have equal sets and signatures; no texts give empty arrays.
"""

from __future__ import annotations

import numpy as np

from . import bytescan

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
OPEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, A-Z lower-cased.

    A text of fewer words is one shingle; one without words has none.
    """
    raw = [(t or "").encode().translate(_LOWER) for t in texts]
    out: list[np.ndarray] = []
    for a, b in bytescan.batches(raw):
        data, bounds = bytescan.laid(raw[a:b])
        starts, ends = bytescan.words(data)
        words = bytescan.identities(data, starts, ends)
        factors = bytescan.powers(int(_STEP), width + 2)
        joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            joined += words[k : k + len(joined)] * factors[k + 1]
        joined = bytescan.mixed(joined)
        first = np.searchsorted(starts, bounds)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= width:
                out.append(np.unique(joined[s : e - width + 1]))
            elif e > s:
                short = (words[s:e] * factors[1 : e - s + 1]).sum(dtype=np.uint64) + np.uint64(e - s)
                out.append(bytescan.mixed(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row for each set (all slots OPEN for an empty one).

    In round j each element proposes j + r for the slot that is jth in its own permutation of the
    slots, so proposals of one element never compete and later rounds never beat earlier ones.
    A set stops after the round in which its last slot was filled. The permutation of an element
    is drawn a step at a time (Fisher-Yates), for all elements of all open sets together.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    sign = np.full(len(sets) * slots, OPEN, np.uint64)
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order: np.ndarray | None = None
    for j in range(slots):
        if not len(hashes):
            break
        drawn = bytescan.mixed(hashes + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        value = (drawn >> np.uint64(8)) | (np.uint64(j) << np.uint64(56))
        k = j + (bytescan.mixed(drawn) >> np.uint64(32)).astype(np.int64) % (slots - j)
        if order is None:
            slot = k
        else:
            row = np.arange(len(hashes))
            slot = order[row, k].astype(np.int64)
            order[row, k] = order[row, j]
        np.minimum.at(sign, owner * slots + slot, value)
        still = (sign.reshape(-1, slots) == OPEN).any(axis=1)
        keep = still[owner]
        if order is None:
            hashes, owner, k = hashes[keep], owner[keep], k[keep]
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(hashes), slots)).copy()
            order[np.arange(len(hashes)), k] = 0
        elif not keep.all():
            hashes, owner, order = hashes[keep], owner[keep], order[keep]
    return sign.reshape(-1, slots)


def band_hashes(signs: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each run of slots."""
    rows = signs.shape[1] // bands
    parts = signs[:, : bands * rows].reshape(len(signs), bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.ones((len(signs), 1), np.uint64)
    for k in range(rows):
        out = bytescan.mixed(out * _STEP + parts[:, :, k])
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash modulo the width; about eight bits an element, a power of two."""
    width = max(256, 1 << (8 * max(1, len(hashes)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller width, as 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)
