"""Vectorised text kernels over Arrow string arrays: word spans, word hashes, token ids.

Words are maximal runs of ASCII letters and digits and of bytes from 0x80 up; callers lower the
text on the JVM side before it is sent here. All hashes are unsigned 64-bit, wrapping.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ODD = U64(0x9E3779B97F4A7C15)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; works in place on a fresh copy."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n - 1).bit_length()))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(off: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own, whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of several documents: hash, start and end byte, document row, index in the document."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.n_docs = len(off) - 1
        inside = WORD_BYTE[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside
        before[off[:-1]] = False  # a document's first byte follows nothing
        after = np.zeros(len(raw) + 1, bool)
        after[:-1] = inside
        after[off[1:]] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, off)  # index of each document's first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.hash = self._hash(raw, inside)

    @property
    def index(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)

    def _hash(self, raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        at = np.flatnonzero(inside)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        pw = powers(int(length.max()) + 1)
        within = np.arange(len(at)) - np.repeat(begin, length)
        value = (raw[at].astype(U64) + U64(1)) * pw[within]
        return mix(np.add.reduceat(value, begin) + length.astype(U64) * _M2)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-grams, and the word index (over all documents) at which each begins."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        value = np.zeros(n, U64)
        for j in range(k):
            value *= _ODD
            value += self.hash[j : j + n]
        return mix(value[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tokenizer_path() -> str:
    """The byte-level BPE ranks used by default; any file of the same form may be named instead."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


#: The published pre-tokenisation rule of that vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = 50_257
END = 50_256


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """The token ids of a whole text."""
    return np.asarray(encoder(path).encode_ordinary(text), np.int32)
