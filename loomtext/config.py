"""Settings of canonicalisation, tokenisation and sketching, their names and their hash."""

from __future__ import annotations

from dataclasses import dataclass, replace

import xxhash

from loomtext.errors import ConfigError

SEED = 0x00C0FFEE5EED
XXH3, MURMUR3 = "xxh3-64", "mmh3-x64-128"
SCHEMA = 1


@dataclass(frozen=True)
class Canonical:
    """strip, normalise, fold case, normalise again, and on request replace look-alike characters."""

    normalization: str = "nfkc"  # nfc, nfkc or none
    case_fold: bool = True
    strip_bidi: bool = True
    strip_format: bool = True
    confusable: bool = False

    def __post_init__(self) -> None:
        if self.normalization not in ("nfc", "nfkc", "none"):
            raise ConfigError(f"no such normalisation: {self.normalization}")

    def name(self) -> str:
        flags = (("-bidi", self.strip_bidi), ("-fmt", self.strip_format), ("-conf", self.confusable))
        return f"{self.normalization}-{'cf-simple' if self.case_fold else 'cf-none'}" + "".join(n for n, on in flags if on)


@dataclass(frozen=True)
class Tokens:
    """Words, graphemes or CJK words; ``shingle`` lists window sizes, the innermost first."""

    kind: str = "word"  # word, grapheme, cjk-jieba, cjk-lindera-ipadic, cjk-lindera-ko-dic
    shingle: tuple[int, ...] = ()
    hmm: bool = False

    KINDS = ("word", "grapheme", "cjk-jieba", "cjk-lindera-ipadic", "cjk-lindera-ko-dic")

    def __post_init__(self) -> None:
        if self.kind not in self.KINDS:
            raise ConfigError(f"no such tokenizer: {self.kind}")
        if any(k < 0 for k in self.shingle):
            raise ConfigError("a shingle has no negative length")

    def shingled(self, k: int) -> Tokens:
        return replace(self, shingle=(*self.shingle, k))

    def name(self) -> str:
        inner = self.kind + ("-uax29" if self.kind in ("word", "grapheme") else "") + ("-hmm" if self.kind == "cjk-jieba" and self.hmm else "")
        for k in self.shingle:
            inner = f"shingle-k={k}/{inner}"
        return inner


WORDS = Tokens()
GRAPHEMES = Tokens("grapheme")


@dataclass(frozen=True)
class MinHash:
    slots: int = 128
    tokens: Tokens = Tokens(shingle=(5,))
    canonical: Canonical = Canonical()
    family: str = XXH3
    seed: int = SEED

    def __post_init__(self) -> None:
        if self.slots < 1:
            raise ConfigError("a signature has at least one slot")
        _check_hash(self.family, self.seed)

    def algorithm(self) -> str:
        return "minhash-h128" if self.slots == 128 else "minhash"


@dataclass(frozen=True)
class SimHash:
    tokens: Tokens = WORDS
    weighting: str = "tf"  # tf, uniform or idf
    canonical: Canonical = Canonical()
    family: str = XXH3
    seed: int = SEED

    def __post_init__(self) -> None:
        if self.weighting not in ("tf", "uniform", "idf"):
            raise ConfigError(f"no such weighting: {self.weighting}")
        _check_hash(self.family, self.seed)

    def algorithm(self) -> str:
        return "simhash-b64"


def _check_hash(family: str, seed: int) -> None:
    if family not in (XXH3, MURMUR3):
        raise ConfigError(f"no such hash family: {family}")
    if not 0 <= seed < 1 << 64:
        raise ConfigError("the seed is an unsigned 64-bit number")


def config_hash(canonical: str, tokens: str, algorithm: str) -> int:
    """Of the three names, as the bit pattern of a bigint; 0 stands for not computed."""
    return _signed(xxhash.xxh3_64_intdigest(f"{canonical}|{tokens}|{algorithm}".encode()))


def config_hash_of(config: MinHash | SimHash) -> int:
    """As :func:`config_hash`, with hash family and seed."""
    named = f"{config.canonical.name()}|{config.tokens.name()}|{config.algorithm()}|{config.family}|seed:{config.seed:016x}"
    return _signed(xxhash.xxh3_64_intdigest(named.encode()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
