"""The functions under names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext.config import GRAPHEMES, WORDS, Canonical, MinHash, SimHash
from loomtext.functions.sketches import SIGNATURE, signatures
from loomtext.functions.text import mapped
from loomtext.kernels import canon, chunk, html, markdown, sketch, tlsh
from loomtext.kernels.words import shingles, tokenizer
from loomtext.errors import InvalidInput


def register(spark: SparkSession, canonical: Canonical = Canonical(), minhash: MinHash = MinHash(), simhash: SimHash = SimHash(), prefix: str = "") -> list[str]:
    """Registers everything with these settings and returns the names. Failures of a row give null."""
    strings = pa.list_(pa.string())

    def scalar(kind: str, arrow: pa.DataType, f):
        return F.arrow_udf(lambda v: mapped(v, f, arrow), kind)

    def minhash_of(texts: pa.Array) -> pa.Array:
        return signatures(*sketch.minhash(texts.to_pylist(), minhash))

    def simhash_of(texts: pa.Array) -> pa.Array:
        found, some = sketch.simhash(texts.to_pylist(), simhash)
        return pa.array(found.view(np.int64), mask=~some)

    def tlsh_of(text: str):
        try:
            return tlsh.digest(canon.canonical(text, canonical).encode("utf-8", "surrogatepass"))
        except InvalidInput:
            return None

    words, graphemes = tokenizer(WORDS), tokenizer(GRAPHEMES)
    found = {
        "canonicalize": scalar("string", pa.string(), lambda t: canon.canonical(t, canonical)),
        "word_tokens": scalar("array<string>", strings, words),
        "graphemes": scalar("array<string>", strings, graphemes),
        "minhash": F.arrow_udf(minhash_of, SIGNATURE),
        "simhash": F.arrow_udf(simhash_of, "bigint"),
        "tlsh_digest": scalar("string", pa.string(), tlsh_of),
        "html_to_text": scalar("string", pa.string(), html.text),
        "markdown_to_text": scalar("string", pa.string(), markdown.text),
        "text_chunks": scalar("array<string>", strings, chunk.chunks),
    }
    for name, f in found.items():
        spark.udf.register(prefix + name, f)

    class Shingles:
        def eval(self, text: str, k: int) -> Iterator[tuple[int, str]]:
            if text is not None:
                yield from enumerate(shingles(words(text), k))

    class Chunks:
        def eval(self, text: str, most: int, overlap: int, mode: str) -> Iterator[tuple[int, str]]:
            if text is not None:
                yield from enumerate(chunk.chunks(text, most, overlap, mode))

    spark.udtf.register(prefix + "explode_shingles", F.udtf(Shingles, returnType="pos int, shingle string"))
    spark.udtf.register(prefix + "explode_chunks", F.udtf(Chunks, returnType="pos int, piece string"))
    natives = {
        "minhash_jaccard": "(a STRUCT<schema: SMALLINT, hashes: ARRAY<BIGINT>>, b STRUCT<schema: SMALLINT, hashes: ARRAY<BIGINT>>) RETURNS FLOAT RETURN aggregate(zip_with(a.hashes, b.hashes, (x, y) -> int(x = y)), 0, (s, e) -> s + coalesce(e, 0)) / size(a.hashes)",
        "simhash_hamming": "(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    }
    for name, body in natives.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
    return [prefix + n for n in (*found, "explode_shingles", "explode_chunks", *natives)]
