"""Document fingerprints by winnowing.

Letters and digits of a text, each lowered on its own, form a character string; every run of K of
them is hashed by a rolling polynomial, the smallest hash of every WINDOW neighbouring hashes is kept
(of equal ones the rightmost), once, together with the position in the original text at which the
run begins. Two texts that share WINDOW + K - 1 consecutive letters or digits share a fingerprint;
no match shorter than K makes one.

Defined results: a null or empty text, and one with fewer than K letters and digits, has no row; with
fewer than WINDOW hashes all of them form the one window. Repeated rows are fingerprinted each on
its own, so they repeat in the result; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import spread, table

K, WINDOW = 25, 40
PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_069)
SCHEMA = "doc_id bigint, position int, fingerprint bigint"
_BLOCK = 1_000_000


@lru_cache(1)
def _folding() -> np.ndarray:
    """Per code point its lower form, 0 where it is neither letter nor digit."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(4)
def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done, step = 1, base % PRIME
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * step % PRIME
        step = step * step % PRIME
        done += m
    return out


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, 1 << max(20, n.bit_length()))


def _rolling(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbours: two polynomials modulo PRIME side by side in 62 bits."""
    n = len(code) - k + 1
    out = np.zeros(max(n, 0), np.int64)
    if n <= 0:
        return out
    for base in BASES:
        up, down = _powers(base, len(code)), _powers(pow(base, -1, PRIME), len(code))
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(code * up[: len(code)] % PRIME, out=total[1:])
        out <<= 31
        out |= (total[k:] - total[:n]) % PRIME * down[:n] % PRIME
    return out


def _select(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Indices kept, ascending; ``first`` has each document's first hash, and the end."""
    counts = np.diff(first)
    kept = []
    if (counts >= window).any():
        value, at, width = hashes, np.arange(len(hashes), dtype=np.int64), 1
        while width < window:
            step = min(width, window - width)
            right = value[step:] <= value[:-step]
            at = np.where(right, at[step:], at[:-step])
            value = np.where(right, value[step:], value[:-step])
            width += step
        doc_end = np.repeat(first[1:], counts)[: len(at)]
        at = at[np.arange(len(at)) + window <= doc_end]
        kept.append(at[np.r_[True, at[1:] != at[:-1]]])
    short = np.flatnonzero((counts > 0) & (counts < window))
    for d in short:
        own = hashes[first[d] : first[d + 1]]
        kept.append(np.array([first[d + 1] - 1 - int(np.argmin(own[::-1]))]))
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def winnow(texts: list[str | None], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of each fingerprint of some texts."""
    texts = [t or "" for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    code = _folding()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    off = np.r_[0, np.cumsum(size)]
    kept = np.flatnonzero(code)
    code = code[kept]
    start = np.searchsorted(kept, off)  # first kept character of each text
    hashes = _rolling(code, k)
    doc = np.repeat(np.arange(len(texts)), np.diff(start))
    n = len(hashes)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
    hashes, owner = hashes[whole], doc[:n][whole]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    chosen = _select(hashes, first, window)
    row = owner[chosen]
    return row, kept[whole[chosen]] - off[row], hashes[chosen]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t or "") > _BLOCK:
            yield i, j
            i, size = j, 0
        size += len(t or "")
    if texts:
        yield i, len(texts)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text); narrow work, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _batches(texts):
                row, position, value = winnow(texts[i:j], k, window)
                ids = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(position.astype(np.int32)), pa.array(value)], names=["doc_id", "position", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("text != ''").mapInArrow(run, SCHEMA)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spread(table(spark, sf_dir, "documents")))


def _poly(base: int) -> str:
    terms = [f"lead(c, {j}) OVER w * {pow(base, j, PRIME)}" if j else "c" for j in range(K)]
    return f"({' + '.join(terms)}) % {PRIME}"


#: Every character in one row; each polynomial is spelt out term by term.
SQL = f"""
WITH chars AS (
  SELECT doc_id, unnest(range(len(text))) AS pos, unnest(string_split(text, '')) AS ch FROM documents WHERE text != ''
), kept AS (
  SELECT doc_id, pos, unicode(lower(ch))::BIGINT AS c FROM chars WHERE regexp_full_match(ch, '[\\p{{L}}\\p{{N}}]')
), rolled AS (
  SELECT doc_id, pos, {_poly(BASES[0])} AS h1, {_poly(BASES[1])} AS h2,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) - {K - 1} AS n
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), hashed AS (
  SELECT doc_id, pos, i, n, (h1 << 31) | h2 AS h FROM rolled WHERE i <= n
), minima AS (
  SELECT doc_id, i, n, min(h::HUGEINT * 4294967296 + (4294967295 - pos)) OVER
         (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS m
  FROM hashed
)
SELECT DISTINCT doc_id, (4294967295 - m % 4294967296)::INTEGER AS position, (m // 4294967296)::BIGINT AS fingerprint
FROM minima WHERE i <= greatest(1, n - {WINDOW - 1})
"""
