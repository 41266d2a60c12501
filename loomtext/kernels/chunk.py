"""Splitting of long texts into pieces for embedding models; a word counts as 1.3 tokens."""

from __future__ import annotations

import numpy as np

from loomtext.errors import ConfigError
from loomtext.kernels.words import sentences, words

_RATE = np.float32(1.3)
MODES = ("fixed", "sentence", "recursive")


def approx_tokens(n_words: int) -> int:
    return int(np.ceil(np.float32(n_words) * _RATE))


def _in_words(tokens: int) -> int:
    return int(np.floor(np.float32(tokens) / _RATE))


def fixed(text: str, most: int, overlap: int) -> list[str]:
    """Windows of words, each overlapping the one before."""
    own = words(text)
    width = max(1, _in_words(most))
    step = width - min(_in_words(overlap), width - 1)
    starts = range(0, max(1, len(own) - width + step), step) if own else ()
    return [" ".join(own[i : i + width]) for i in starts if i == 0 or i - step + width < len(own)]


def bounded(text: str, most: int, overlap: int) -> list[str]:
    """Sentences packed in order; a new piece begins with the last words of the one before."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in sentences(text):
        n = approx_tokens(len(words(sentence)))
        if n > most:  # too long by itself
            if held:
                out.append(" ".join(held))
            held, size = [], 0
            out += fixed(sentence, most, overlap)
            continue
        if held and size + n > most:
            out.append(" ".join(held))
            held, size = [], 0
            if overlap:
                last = words(out[-1])
                kept = last[max(0, len(last) - _in_words(overlap)) :]
                if kept:
                    held, size = [" ".join(kept)], approx_tokens(len(kept))
        held.append(sentence)
        size += n
    return out + [" ".join(held)] if held else out


def recursive(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs packed in order, without overlap; one that is too long is split by sentences."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        n = approx_tokens(len(words(paragraph)))
        if held and (n > most or size + n > most):
            out.append("\n\n".join(held))
            held, size = [], 0
        if n > most:
            out += bounded(paragraph, most, overlap)
            continue
        held.append(paragraph)
        size += n
    return out + ["\n\n".join(held)] if held else out


def chunks(text: str, most: int = 256, overlap: int = 32, mode: str = "sentence") -> list[str]:
    if mode not in MODES:
        raise ConfigError(f"no such way to split: {mode}")
    if most <= 0 or not text:
        return []
    return {"fixed": fixed, "sentence": bounded, "recursive": recursive}[mode](text, most, overlap)
