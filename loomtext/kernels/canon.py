"""Canonical form of a text."""

from __future__ import annotations

import re
import unicodedata

from loomtext.config import Canonical

#: Bidirectional controls.
BIDI = "‪-‮⁦-⁩‎‏"
#: Everything invisible that is taken out: joiners, selectors, tags and the controls above.
FORMAT = "​-‏⁠-⁤؜᠋-᠏﻿︀-️\U000e0100-\U000e01ef\U000e0001\U000e0020-\U000e007f‪-‮⁦-⁩"
_BIDI, _FORMAT = re.compile(f"[{BIDI}]+"), re.compile(f"[{FORMAT}]+")


def canonical(text: str, config: Canonical = Canonical(), skeletons: dict[int, str] | None = None) -> str:
    """Idempotent unless ``skeletons`` (for :attr:`Canonical.confusable`) map onto something they map again."""
    if config.strip_format:
        text = _FORMAT.sub("", text)
    elif config.strip_bidi:
        text = _BIDI.sub("", text)
    form = None if config.normalization == "none" else config.normalization.upper()
    if form:
        text = unicodedata.normalize(form, text)
    if config.case_fold:
        text = text.casefold()
        if form and not text.isascii():
            text = unicodedata.normalize(form, text)
    if config.confusable and skeletons is not None:
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(skeletons))
    return text


def skeletons_from_jvm(spark) -> dict[int, str]:
    """Prototype of every look-alike code point, from the ICU library that Spark brings along."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and unicodedata.normalize("NFD", chr(c)) == chr(c)]
    found: dict[int, str] = {}
    for i in range(0, len(points), 20_000):
        part = points[i : i + 20_000]
        made = checker.getSkeleton("\n".join(map(chr, part))).split("\n")
        if len(made) != len(part):  # a part that does not come back point by point is asked singly
            made = [checker.getSkeleton(chr(c)) for c in part]
        found.update({c: s for c, s in zip(part, made) if s != chr(c)})
    return found
