"""Canonical text, tokens, shingles, chunks and text extraction as columns.

Everywhere: null in, null out; an empty text has an empty canonical form, no tokens and no chunks. Of extractors that
can fail per row, ``on_error`` says what becomes of a failure: a column of value and error, null, or an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column as _Column

from loomtext.config import WORDS, Canonical, Tokens
from loomtext.errors import ConfigError, InvalidInput
from loomtext.kernels import canon, chunk, html, markdown, pdf
from loomtext.kernels.words import tokenizer

_TOKEN_LIST = pa.list_(pa.string())
#: Bytes of a batch that are Python objects at a time.
PIECE = 4 << 20


def col(c: Column | str) -> Column:
    return c if isinstance(c, _Column) else F.col(c)


def settled(result: Column, field: str, on_error: str) -> Column:
    """``result`` has ``field`` and ``error``."""
    if on_error == "column":
        return result
    if on_error == "null":
        return result[field]
    if on_error == "raise":
        return F.when(F.assert_true(result["error"].isNull(), result["error"]).isNull(), result[field])
    raise ConfigError(f"no such error policy: {on_error}")


def pieces(values: pa.Array) -> Iterator[list]:
    """Runs of rows of about PIECE bytes, at least an empty one: texts, tokens and hashes as Python objects are many times as large as in Arrow, so a batch never is that as a whole."""
    step = max(1, len(values) * PIECE // max(1, values.nbytes))
    for first in range(0, max(1, len(values)), step):
        yield values.slice(first, step).to_pylist()


def mapped(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([None if x is None else f(x) for x in part], kind) for part in pieces(values)])


def canonicalize(text: Column | str, config: Canonical = Canonical(), skeletons: dict[int, str] | None = None) -> Column:
    """Canonical text; plain ASCII is lowered without leaving Arrow. ``skeletons``: see :func:`confusable_map`."""
    if config.confusable and skeletons is None:
        skeletons = confusable_map(SparkSession.active())

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        if config.confusable:
            return mapped(values, lambda t: canon.canonical(t, config, skeletons), pa.string())
        plain = pc.fill_null(pc.string_is_ascii(values), True)
        easy = pc.ascii_lower(values) if config.case_fold else values
        if pc.all(plain).as_py() in (True, None):
            return easy
        hard = [canon.canonical(t, config) for t in values.filter(pc.invert(plain)).to_pylist()]
        return pc.replace_with_mask(easy, pc.invert(plain), pa.array(hard, values.type))

    return run(col(text).cast("string"))


def confusable_map(spark: SparkSession) -> dict[int, str]:
    """Prototypes of look-alike characters; of fixed size (some thousand), so it may travel with the plan."""
    return canon.skeletons_from_jvm(spark)


def tokens(text: Column | str, config: Tokens = WORDS, canonical: Canonical | None = None) -> Column:
    """Tokens of the text as it is, or of its canonical form if ``canonical`` is given."""
    cut = tokenizer(config)

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        f = cut if canonical is None else lambda t: cut(canon.canonical(t, canonical))
        return mapped(values, f, _TOKEN_LIST)

    return run(col(text).cast("string"))


def token_count(text: Column | str, config: Tokens = WORDS, canonical: Canonical | None = None) -> Column:
    """Number of tokens, without moving them to the JVM."""
    cut = tokenizer(config)

    @F.arrow_udf("int")
    def run(values: pa.Array) -> pa.Array:
        return mapped(values, (lambda t: len(cut(t))) if canonical is None else lambda t: len(cut(canon.canonical(t, canonical))), pa.int32())

    return run(col(text).cast("string"))


def shingles(token_list: Column | str, k: int) -> Column:
    """Runs of k tokens joined by a space, on the JVM side; see the kernel for short lists."""
    if k < 0:
        raise ConfigError("a shingle has no negative length")
    c = col(token_list)
    none = F.array().cast("array<string>")
    if k == 0:
        return F.when(c.isNotNull(), none)
    runs = F.transform(F.sequence(F.lit(1), F.size(c) - k + 1), lambda i: F.array_join(F.slice(c, i, k), " "))
    return F.when(c.isNull(), None).when(F.size(c) == 0, none).when(F.size(c) < k, F.array(F.array_join(c, " "))).otherwise(runs)


def visible_html(page: Column | str) -> Column:
    """The page without scripts and style sheets, on the JVM side."""
    return F.regexp_replace(col(page), html.HIDDEN, "")


def html_to_text(page: Column | str) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return mapped(values, html.text, pa.string())

    return run(col(page).cast("string"))


def markdown_to_text(source: Column | str, options: markdown.Options = markdown.Options()) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return mapped(values, lambda t: markdown.text(t, options), pa.string())

    return run(col(source).cast("string"))


def failing(values: list, f: Callable, kind: pa.DataType, name: str) -> pa.StructArray:
    """Results beside errors."""
    out, errors = [], []
    for v in values:
        try:
            out.append(None if v is None else f(v))
            errors.append(None)
        except InvalidInput as e:
            out.append(None)
            errors.append(str(e))
    return pa.StructArray.from_arrays([pa.array(out, kind), pa.array(errors, pa.string())], [name, "error"])


def pdf_to_text(content: Column | str, options: pdf.Options = pdf.Options(), on_error: str = "column") -> Column:
    """Text of PDF bytes. What is too large by its length is refused before it leaves the JVM."""
    c = col(content)
    fits = F.octet_length(c) <= options.max_bytes

    @F.arrow_udf("struct<text: string, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return failing(values.to_pylist(), lambda b: pdf.text(b, options), pa.string(), "text")

    too_large = F.struct(F.lit(None).cast("string").alias("text"), F.lit(f"the file is larger than {options.max_bytes} bytes").alias("error"))
    return settled(F.when(c.isNotNull() & ~fits, too_large).otherwise(run(F.when(fits, c))), "text", on_error)


def chunks(text: Column | str, max_tokens: int = 256, overlap: int = 32, mode: str = "sentence") -> Column:
    """Pieces of about ``max_tokens`` tokens in document order."""
    if mode not in chunk.MODES:
        raise ConfigError(f"no such way to split: {mode}")

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        return mapped(values, lambda t: chunk.chunks(t, max_tokens, overlap, mode), _TOKEN_LIST)

    return run(col(text).cast("string"))


def fixed_chunks(words: Column | str, max_tokens: int, overlap: int) -> Column:
    """The fixed windows over a list of words, on the JVM side."""
    c = col(words)
    if max_tokens <= 0:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    rate = np.float32(1.3)
    width = max(1, int(np.floor(np.float32(max_tokens) / rate)))
    step = width - min(int(np.floor(np.float32(max(0, overlap)) / rate)), width - 1)
    last = F.greatest(F.lit(0), F.ceil((F.size(c) - width) / F.lit(step))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(c, i * step + 1, width), " "))
    return F.when(c.isNull(), None).when(F.size(c) == 0, F.array().cast("array<string>")).otherwise(windows)


def approx_tokens(n_words: Column) -> Column:
    """1.3 tokens a word, rounded up, in single precision."""
    return F.ceil(n_words.cast("float") * F.lit(1.3).cast("float")).cast("int")
