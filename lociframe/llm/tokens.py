"""Token ids of many texts, as the tokenizers library gives them, with repeated chunks encoded once.

Byte-level BPE splits a text before it merges, and a split always falls before a space that
follows a non-space character. Cut there, the chunks' ids are the text's ids. Each batch's
distinct chunks are found by hash; only those not met before are encoded.

Defined results: None is the empty text and has no ids; strings of special tokens are their
token unless the caller asks for ordinary text; runs of white space and words may be of any
length; equal texts have equal ids.
"""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from . import bytescan

#: The cache starts anew beyond this many chunks.
MOST_CHUNKS = 400_000
#: Fixed value: how byte-level BPE of this family splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as SPLIT counts it. A run of RUN of them is merged without SPLIT, whose look-ahead
#: steps back over a run one character at a time and has a limit on that.
RUN = 4096
_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")

#: Bytes after which a space begins a chunk: printable ASCII, and the end of a character of
#: two bytes led by C3 to DF, none of which is white space.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def _fast(model: dict) -> tiktoken.Encoding | None:
    """The same merges in a faster encoder, if ids rise with merge rank and the split is SPLIT."""
    split = model["pre_tokenizer"] or {}
    plain = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 173 or c >= 174]
    char = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    added = {t["content"] for t in model["added_tokens"]}
    vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in added}
    ranked = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["model"]["merges"]]
    if model["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or None in ranked or ranked != sorted(ranked):
        return None
    ranks = {bytes(char[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("same", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes batches of texts with one tokenizer file; one object for each Python worker."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        self.path = path
        self.tokenizer: Tokenizer | None = None  # read when first asked for
        model = json.loads(Path(path).read_bytes())
        self.specials = [t["content"].encode() for t in model["added_tokens"]]
        self.largest = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])], default=0)
        self.fast = _fast(model)
        self._reset()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def plain(self, texts: list[str], ordinary: bool = False) -> list[np.ndarray]:
        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = ordinary
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _chunk(self, text: str) -> list[int]:
        """Ids of one chunk. A run of white space is one piece, but for its last character where more text follows."""
        if len(text) < RUN:
            return self.fast.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.fast.encode_ordinary(text[at : run.start()])
            ids += self.fast._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.fast.encode_ordinary(text[at:])

    def encode(self, texts: list[str | None], ordinary: bool = False) -> list[np.ndarray]:
        """Ids of each text; None counts as empty. ordinary: strings of special tokens are text."""
        raw = [(t or "").encode() for t in texts]
        odd = set() if ordinary else {k for k, t in enumerate(raw) if any(s in t for s in self.specials)}
        out: list[np.ndarray] = []
        for a, b in bytescan.batches([b"" if k in odd else t for k, t in enumerate(raw)]):
            out += self._encode([b"" if k in odd else raw[k] for k in range(a, b)])
        for k in odd:
            out[k] = self.plain([texts[k]])[0]
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data, bounds = bytescan.laid(texts)
        space = np.zeros(len(data), bool)
        space[1:] = (data[1:] == 32) & (_SOLID[data[:-1]])
        two = (data[2:] == 32) & (data[1:-1] >= 128) & _LEAD[data[:-2]]
        space[2:] |= two
        space[bounds[1:] - 1] = True
        space[bounds[:-1]] = True
        at = np.flatnonzero(space)
        # each text's last byte, the line feed laid after it, makes a chunk of its own that is left out
        ends = np.append(at[1:], len(data))
        real = np.ones(len(at), bool)
        real[np.searchsorted(at, bounds[1:] - 1)] = False
        starts, ends = at[real], ends[real]
        hashes = bytescan.identities(data, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = where < len(self.known)
        new[inside] = self.known[where[inside]] != unique[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > MOST_CHUNKS:
                self._reset()
                new[:] = True
            whole = data.tobytes()
            chunks = [whole[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            got = list(map(self._chunk, chunks)) if self.fast else self.plain(chunks, True)
            counts = np.fromiter(map(len, got), np.int64, len(got))
            begin = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(counts.sum()))])
            order = np.argsort(keys := np.concatenate([self.known, unique[new]]), kind="stable")
            self.known = keys[order]
            self.starts = np.concatenate([self.starts, begin])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            where = np.searchsorted(self.known, unique)
        counts = self.counts[where][inverse]
        upto = np.cumsum(counts)
        ids = self.pool[np.repeat(self.starts[where][inverse] - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)]
        cut = np.concatenate(([0], upto))[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
