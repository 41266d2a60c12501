"""MinHash and SimHash of the tokens of many documents at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

from loomtext.config import MinHash, SimHash, Tokens
from loomtext.kernels.canon import canonical
from loomtext.kernels.hashing import U64, hash128
from loomtext.kernels.words import shingles, tokenizer

EMPTY = "empty document"
_GROUP = 1 << 16  # tokens that are held as bytes at a time
_BLOCK = 1 << 15  # hashes handled at a time, so that the working set stays in the cache


def tokens_of(text: str, tokens: Tokens) -> list[bytes]:
    """Tokens as bytes; the usual single shingle is cut from one joined string."""
    if not tokens.shingle and tokens.kind == "word":  # no word has a space
        joined = " ".join(tokenizer(tokens)(text)).encode("utf-8", "surrogatepass")
        return joined.split(b" ") if joined else []
    if len(tokens.shingle) != 1:
        return [t.encode("utf-8", "surrogatepass") for t in tokenizer(tokens)(text)]
    base, k = tokenizer(Tokens(tokens.kind, (), tokens.hmm))(text), tokens.shingle[0]
    if k == 0 or len(base) <= k:
        return [t.encode("utf-8", "surrogatepass") for t in shingles(base, k)]
    if tokens.kind == "word":
        joined = " ".join(base).encode("utf-8", "surrogatepass")
        ends = np.r_[np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)]
    else:
        parts = [t.encode("utf-8", "surrogatepass") for t in base]
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[a:b] for a, b in zip(starts[: len(base) - k + 1].tolist(), ends[k - 1 :].tolist())]


def hashed(texts: list[str | None], config: MinHash | SimHash, ready: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of documents: first and end row, low and high halves, offsets of the documents among them."""
    group, sizes, first = [], [], 0
    for i, text in enumerate(texts):
        own = [] if not text else tokens_of(text if ready else canonical(text, config.canonical), config.tokens)
        group += own
        sizes.append(len(own))
        if len(group) >= _GROUP or i == len(texts) - 1:
            lo, hi = hash128(group, config.family, config.seed)
            yield first, i + 1, lo, hi, np.r_[0, np.cumsum(sizes)].astype(np.int64)
            group, sizes, first = [], [], i + 1


def minhash_slots(lo: np.ndarray, hi: np.ndarray, off: np.ndarray, slots: int) -> np.ndarray:
    """Unsigned minimum of lo + i * hi over each document's tokens; all ones without tokens."""
    out = np.full((len(off) - 1, slots), ~U64(0), U64)
    d = 0
    while d < len(off) - 1:
        e = max(d + 1, int(np.searchsorted(off, off[d] + _BLOCK, "right")) - 1)
        rows = np.arange(d, e)[np.diff(off[d : e + 1]) > 0]
        if len(rows) == 1 and off[e] - off[d] > _BLOCK:  # one long document, in pieces
            for a in range(int(off[d]), int(off[e]), _BLOCK):
                b = min(a + _BLOCK, int(off[e]))
                value = lo[a:b].copy()
                for i in range(slots):
                    out[rows[0], i] = min(out[rows[0], i], value.min())
                    value += hi[a:b]
        elif len(rows):
            a, b = int(off[d]), int(off[e])
            begin, value, step = off[rows] - a, lo[a:b].copy(), hi[a:b]
            for i in range(slots):
                out[rows, i] = np.minimum.reduceat(value, begin)
                value += step
        d = e
    return out


def minhash(texts: list[str | None], config: MinHash, ready: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and whether a document had tokens."""
    out, some = np.full((len(texts), config.slots), ~U64(0), U64), np.zeros(len(texts), bool)
    for i, j, lo, hi, off in hashed(texts, config, ready):
        out[i:j] = minhash_slots(lo, hi, off, config.slots)
        some[i:j] = np.diff(off) > 0
    return out, some


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Whole part of tf * idf within 1e15 either way; 1 where that is not finite."""
    with np.errstate(all="ignore"):
        w = tf.astype(np.float32) * idf.astype(np.float32)
    return np.where(np.isfinite(w), np.trunc(np.clip(w.astype(np.float64), -1e15, 1e15)), 1).astype(np.int64)


def simhash_bits(lo: np.ndarray, off: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Bit b is set where the weights of tokens with it outweigh those without."""
    out = np.zeros(len(off) - 1, U64)
    d = 0
    while d < len(off) - 1:
        e = max(d + 1, int(np.searchsorted(off, off[d] + _BLOCK, "right")) - 1)
        rows = np.arange(d, e)[np.diff(off[d : e + 1]) > 0]
        if len(rows):
            a, b = int(off[d]), int(off[e])
            begin, bits = off[rows] - a, np.empty(b - a, np.int64)
            every = np.diff(off[d : e + 1])[rows - d] if weight is None else np.add.reduceat(weight[a:b], begin)
            total = np.empty((len(rows), 64), np.int64)
            for bit in range(64):
                np.right_shift(lo[a:b], U64(bit), out=bits.view(U64))
                np.bitwise_and(bits, 1, out=bits)
                if weight is not None:
                    np.multiply(bits, weight[a:b], out=bits)
                total[:, bit] = 2 * np.add.reduceat(bits, begin) - every  # those with it less those without
            out[rows] = np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()
        d = e
    return out


def counted(texts: list[str | None], config: SimHash, ready: bool = False) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """For groups of documents: first and end row, each document's different tokens, how often it has them, and its offsets among them."""
    group, often, sizes, first = [], [], [], 0
    for i, text in enumerate(texts):
        own = Counter(() if not text else tokens_of(text if ready else canonical(text, config.canonical), config.tokens))
        group += own
        often += own.values()
        sizes.append(len(own))
        if len(group) >= _GROUP or i == len(texts) - 1:
            yield first, i + 1, group, np.array(often, np.int64), np.r_[0, np.cumsum(sizes)].astype(np.int64)
            group, often, sizes, first = [], [], [], i + 1


def simhash(texts: list[str | None], config: SimHash, idf: dict[str, float] | None = None, ready: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, and whether a document had tokens. ``idf`` holds weights by token, 1 where it has none."""
    out, some = np.zeros(len(texts), U64), np.zeros(len(texts), bool)
    table = idf or {}
    for i, j, group, tf, off in counted(texts, config, ready):
        if config.weighting == "idf":
            tf = weights(tf, np.array([table.get(t.decode("utf-8", "surrogatepass"), 1.0) for t in group], np.float32))
        place = {t: n for n, t in enumerate(dict.fromkeys(group))}  # documents have most of their words in common
        lo = hash128(list(place), config.family, config.seed)[0][np.fromiter(map(place.__getitem__, group), np.int64, len(group))]
        out[i:j], some[i:j] = simhash_bits(lo, off, None if config.weighting == "uniform" else tf), np.diff(off) > 0
    return out, some
