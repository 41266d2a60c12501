"""Words, graphemes, sentences and shingles by the rules of Unicode text segmentation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

from loomtext.config import Tokens
from loomtext.errors import FeatureDisabled



def _word_pattern() -> regex.Pattern:
    """Chains of letters, digits, katakana and connectors; each unit takes the marks and format characters behind it."""
    of = lambda *names: "[" + "".join(rf"\p{{Word_Break={n}}}" for n in names) + "]"
    marks = of("Extend", "Format", "ZWJ") + "*"
    letter, hebrew, digit = of("ALetter", "Hebrew_Letter"), of("Hebrew_Letter"), of("Numeric")
    in_letters, in_digits = of("MidLetter", "MidNumLet", "Single_Quote"), of("MidNum", "MidNumLet", "Single_Quote")
    letters = f'(?:{letter}{marks}(?:{in_letters}{marks}(?={letter})|(?<={hebrew}{marks})(?:\'{marks}|"{marks}(?={hebrew})))?)'
    digits = f"(?:{digit}{marks}(?:{in_digits}{marks}(?={digit}))?)"
    run = f"(?:(?:{letters}|{digits})+|(?:{of('Katakana')}{marks})+)"
    joint = f"(?:{of('ExtendNumLet')}{marks})"
    return regex.compile(f"(?s){joint}*{run}(?:{joint}+{run})*{joint}*|.{marks}")


_WORD = _word_pattern()
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_CLUSTER = regex.compile(r"\X")
#: The same rules where all is ASCII: letters join over . ' and :, digits over . ' , and ;
_ASCII = re.compile(r"[A-Za-z0-9_]+(?:(?:(?<=[A-Za-z])[.':](?=[A-Za-z])|(?<=[0-9])[.',;](?=[0-9]))[A-Za-z0-9_]+)*")


@lru_cache(1)
def _european() -> tuple[frozenset[str], re.Pattern]:
    """Characters of European texts that need no more than the ASCII rules, and these rules with their letters."""
    letter, other = regex.compile(r"\p{Word_Break=ALetter}"), regex.compile(r"\p{Word_Break=Other}")
    points = [chr(c) for c in (*range(0x80, 0x250), *range(0x370, 0x500), *range(0x2010, 0x2028), *range(0x2030, 0x2060), *range(0x20A0, 0x20C0))]
    letters = "".join(c for c in points if letter.match(c))
    rest = [c for c in points if other.match(c) and not _ALNUM.match(c)]
    of = f"[A-Za-z{letters}]"
    run = f"[A-Za-z0-9_{letters}]+"
    pattern = re.compile(rf"{run}(?:(?:(?<={of})[.':](?={of})|(?<=[0-9])[.',;](?=[0-9])){run})*")
    return frozenset([*map(chr, range(0x80)), *letters, *rest]), pattern


def words(text: str) -> list[str]:
    """Words that have a letter or a digit."""
    ascii_ = text.isascii()
    known, pattern = (None, _ASCII) if ascii_ else _european()
    if ascii_ or known.issuperset(text):
        found = pattern.findall(text)
        return [w for w in found if w.strip("_")] if "_" in text else found
    return [w for w in _WORD.findall(text) if _ALNUM.search(w)]


def graphemes(text: str) -> list[str]:
    """Extended grapheme clusters, white space and punctuation included."""
    if text.isascii() and "\r" not in text:
        return list(text)
    return _CLUSTER.findall(text)


def shingles(tokens: list[str], k: int) -> list[str]:
    """Runs of k tokens joined by a space; fewer tokens make one short run, k = 0 none."""
    if k == 0 or not tokens:
        return []
    if len(tokens) < k:
        return [" ".join(tokens)]
    return [" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]


@lru_cache(1)
def _jieba():
    try:
        import jieba
    except ImportError as e:
        raise FeatureDisabled("the Chinese dictionary segmenter is not installed") from e
    return jieba


def cjk(text: str, kind: str, hmm: bool = False) -> list[str]:
    """Dictionary words without pure white space; Chinese fails without its dictionary. Japanese and Korean use the word rules."""
    if kind == "cjk-jieba":
        return [w for w in _jieba().cut(text, HMM=hmm) if w.strip()]
    return words(text)


def tokenizer(config: Tokens) -> Callable[[str], list[str]]:
    if config.kind == "word":
        base = words
    elif config.kind == "grapheme":
        base = graphemes
    else:
        base = lambda text: cjk(text, config.kind, config.hmm)
    if not config.shingle:
        return base

    def run(text: str) -> list[str]:
        tokens = base(text)
        for k in config.shingle:
            tokens = shingles(tokens, k)
        return tokens

    return run


# Sentences: the class of each character as one letter, marks and format characters left to what they follow, then
# the rules as one pattern over the letters.
_CLASSES = {"CR": "r", "LF": "n", "Sep": "p", "Extend": "x", "Format": "x", "Sp": "s", "Lower": "l", "Upper": "u", "OLetter": "o", "Numeric": "d", "ATerm": "a", "SContinue": "c", "STerm": "t", "Close": "e"}
_OF = [(regex.compile(rf"\p{{Sentence_Break={name}}}"), letter) for name, letter in _CLASSES.items()]
_ENDS = re.compile(
    r"rn|[rnp]"
    r"|a(?!d)(?!(?<=[ul]a)u)e*+s*+(?![^oulrnpat]*l)(?![cat])(?:rn|[rnp])?"
    r"|te*+s*+(?![cat])(?:rn|[rnp])?"
)


class _Letters(dict):
    def __missing__(self, point: int) -> str:
        ch = chr(point)
        self[point] = found = next((letter for pattern, letter in _OF if pattern.match(ch)), ".")
        return found


_LETTERS = _Letters()


def sentences(text: str) -> list[str]:
    """Sentences, trimmed, without empty ones."""
    kinds = text.translate(_LETTERS)
    places = range(len(kinds))
    if "x" in kinds:
        places = [i for i, k in enumerate(kinds) if k != "x" or i == 0 or kinds[i - 1] in "rnp"]
        kinds = "".join(kinds[i] for i in places)
    out, at = [], 0
    for m in _ENDS.finditer(kinds):
        end = places[m.end()] if m.end() < len(kinds) else len(text)
        out.append(text[at:end].strip())
        at = end
    out.append(text[at:].strip())
    return [s for s in out if s]
