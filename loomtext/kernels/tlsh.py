"""Locality-sensitive digest of a byte string after the published scheme: 128 buckets, one byte of checksum."""

from __future__ import annotations

import math

import numpy as np

from loomtext.errors import InvalidInput

LEAST = 50
#: Pearson's permutation of 1990.
TABLE = np.array(
    [1, 87, 49, 12, 176, 178, 102, 166, 121, 193, 6, 84, 249, 230, 44, 163, 14, 197, 213, 181, 161, 85, 218, 80, 64, 239, 24, 226, 236, 142, 38, 200]
    + [110, 177, 104, 103, 141, 253, 255, 50, 77, 101, 81, 18, 45, 96, 31, 222, 25, 107, 190, 70, 86, 237, 240, 34, 72, 242, 20, 214, 244, 227, 149, 235]
    + [97, 234, 57, 22, 60, 250, 82, 175, 208, 5, 127, 199, 111, 62, 135, 248, 174, 169, 211, 58, 66, 154, 106, 195, 245, 171, 17, 187, 182, 179, 0, 243]
    + [132, 56, 148, 75, 128, 133, 158, 100, 130, 126, 91, 13, 153, 246, 216, 219, 119, 68, 223, 78, 83, 88, 201, 99, 122, 11, 92, 32, 136, 114, 52, 10]
    + [138, 30, 48, 183, 156, 35, 61, 26, 143, 74, 251, 94, 129, 162, 63, 152, 170, 7, 115, 167, 241, 206, 3, 150, 55, 59, 151, 220, 90, 53, 23, 131]
    + [125, 173, 15, 238, 79, 95, 89, 16, 105, 137, 225, 224, 217, 160, 37, 123, 118, 73, 2, 157, 46, 116, 9, 145, 134, 228, 207, 212, 202, 215, 69, 229]
    + [27, 188, 67, 124, 168, 252, 42, 4, 29, 108, 21, 247, 19, 205, 39, 203, 233, 40, 186, 147, 198, 192, 155, 33, 164, 191, 98, 204, 165, 180, 117, 76]
    + [140, 36, 210, 172, 41, 54, 159, 8, 185, 232, 113, 196, 231, 47, 146, 120, 51, 65, 28, 144, 254, 221, 93, 189, 194, 139, 112, 43, 71, 109, 184, 209],
    np.uint8,
)
#: Salt and places (back from the newest byte) of each triplet of a window.
TRIPLETS = ((2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4))
_SWAP = lambda x: (x & 15) << 4 | x >> 4


def _length_code(n: int) -> int:
    if n <= 656:
        return int(math.floor(math.log(n) / math.log(1.5))) & 255
    if n <= 3199:
        return int(math.floor(math.log(n) / math.log(1.3) - 8.72777)) & 255
    return int(math.floor(math.log(n) / math.log(1.1) - 62.5472)) & 255


def digest(data: bytes) -> str:
    """T1 and 70 hex digits; refuses what is short or too uniform."""
    if len(data) < LEAST:
        raise InvalidInput(f"at least {LEAST} bytes are needed")
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 4
    at = [b[4 - back : 4 - back + n] for back in range(5)]
    buckets = np.zeros(256, np.int64)
    for salt, i, j, k in TRIPLETS:
        buckets += np.bincount(TABLE[TABLE[TABLE[TABLE[salt] ^ at[i]] ^ at[j]] ^ at[k]], minlength=256)
    buckets = buckets[:128]
    check, table = 0, TABLE.tobytes()
    for x in TABLE[TABLE[TABLE[0] ^ at[0]] ^ at[1]].tobytes():
        check = table[x ^ check]
    ordered = np.sort(buckets)
    q1, q2, q3 = (int(ordered[i]) for i in (31, 63, 95))
    if q3 == 0 or np.count_nonzero(buckets) <= 64:
        raise InvalidInput("the input varies too little")
    level = (buckets > q1).astype(np.uint8) + (buckets > q2) + (buckets > q3)
    code = (level.reshape(32, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ratios = q1 * 100 // q3 % 16 | q2 * 100 // q3 % 16 << 4
    head = bytes([_SWAP(check), _SWAP(_length_code(len(b))), _SWAP(ratios)])
    return "T1" + (head + code[::-1].tobytes()).hex().upper()


def _parse(text: str) -> bytes:
    try:
        raw = bytes.fromhex(text[2:] if text[:2] == "T1" else text)
    except ValueError as e:
        raise InvalidInput("not a digest") from e
    if len(raw) != 35:
        raise InvalidInput("not a digest")
    return raw


#: How far two bytes of four 2-bit levels are apart.
_APART = np.array([sum(6 if abs((x >> s & 3) - (y >> s & 3)) == 3 else abs((x >> s & 3) - (y >> s & 3)) for s in (0, 2, 4, 6)) for x in range(256) for y in range(256)], np.int32).reshape(256, 256)


def distance(one: str, two: str) -> int:
    """0 for equal digests, more for less alike ones; lengths count."""
    a, b = _parse(one), _parse(two)

    def around(x: int, y: int, size: int) -> int:
        return min((x - y) % size, (y - x) % size)

    total = int(a[0] != b[0])
    d = around(_SWAP(a[1]), _SWAP(b[1]), 256)
    total += d if d <= 1 else 12 * d
    for shift in (0, 4):
        d = around(_SWAP(a[2]) >> shift & 15, _SWAP(b[2]) >> shift & 15, 16)
        total += d if d <= 1 else 12 * (d - 1)
    return total + int(_APART[np.frombuffer(a[3:], np.uint8), np.frombuffer(b[3:], np.uint8)].sum())
