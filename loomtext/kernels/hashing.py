"""128-bit hashes of byte strings, as two arrays of unsigned 64-bit halves."""

from __future__ import annotations

import numpy as np
import xxhash

from loomtext.config import MURMUR3, SEED

U64 = np.uint64


def xxh3(keys: list[bytes], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(k, seed) for k in keys]), ">u8").astype(U64)
    return both[1::2], both[::2]


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << U64(n) | x >> U64(64 - n)


def _finish(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> U64(33)) * U64(factor)
    return x ^ x >> U64(33)


_A, _B = U64(0x87C37B91114253D5), U64(0x4CF5AD432745937F)


def murmur3(keys: list[bytes], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The public x64 128-bit function with both lanes started from a 64-bit seed; equally many blocks go together."""
    n = len(keys)
    lo, hi = np.zeros(n, U64), np.zeros(n, U64)
    sizes = np.fromiter(map(len, keys), np.int64, n)
    blocks = sizes // 16
    for count in np.unique(blocks):
        rows = np.flatnonzero(blocks == count)
        width = 16 * (int(count) + 1)
        padded = np.frombuffer(b"".join([keys[i].ljust(width, b"\0") for i in rows]), "<u8").reshape(len(rows), -1).astype(U64)
        a, b = np.full(len(rows), seed, U64), np.full(len(rows), seed, U64)
        for j in range(int(count)):
            a ^= _rotl(padded[:, 2 * j] * _A, 31) * _B
            a = (_rotl(a, 27) + b) * U64(5) + U64(0x52DCE729)
            b ^= _rotl(padded[:, 2 * j + 1] * _B, 33) * _A
            b = (_rotl(b, 31) + a) * U64(5) + U64(0x38495AB5)
        b ^= _rotl(padded[:, -1] * _B, 33) * _A  # a tail of zeros changes nothing
        a ^= _rotl(padded[:, -2] * _A, 31) * _B
        size = sizes[rows].astype(U64)
        a, b = a ^ size, b ^ size
        a = a + b
        b = b + a
        a, b = _finish(a), _finish(b)
        lo[rows] = a + b
        hi[rows] = lo[rows] + b
    return lo, hi


def hash128(keys: list[bytes], family: str, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of each key's hash."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, U64)
    return murmur3(keys, seed) if family == MURMUR3 else xxh3(keys, seed)
