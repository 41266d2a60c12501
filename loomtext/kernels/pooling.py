"""Pooling of a transformer's states into one vector, in single precision."""

from __future__ import annotations

import numpy as np

from loomtext.errors import ConfigError

POOLINGS = ("cls", "mean", "mean_no_norm", "max")


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.sum(v * v, dtype=np.float32))
    return v / norm if norm > 0 and np.isfinite(norm) else v


def pool(hidden: np.ndarray, dim: int, mask: np.ndarray | None = None, pooling: str = "mean") -> np.ndarray:
    """One vector of ``dim`` numbers; a mask that is too short leaves out the rest, nothing kept gives zeros."""
    if pooling not in POOLINGS:
        raise ConfigError(f"no such pooling: {pooling}")
    hidden = np.asarray(hidden, np.float32)
    if dim <= 0 or not hidden.size:
        return np.zeros(0, np.float32)
    rows = hidden[: len(hidden) // dim * dim].reshape(-1, dim)
    if pooling == "cls":
        return unit(rows[0].copy())
    if mask is not None:
        keep = np.zeros(len(rows), bool)
        n = min(len(rows), len(mask))
        keep[:n] = np.asarray(mask[:n]) != 0
        rows = rows[keep]
    if not len(rows):
        out = np.zeros(dim, np.float32)
    elif pooling == "max":
        out = rows.max(axis=0)
    else:
        out = rows.sum(axis=0, dtype=np.float32) * (np.float32(1) / np.float32(len(rows)))
    return out if pooling == "mean_no_norm" else unit(out)
