"""Documents that arrive as chunks of bytes (id, seq, chunk): in a table, or in a stream.

A chunk may end inside a character. A document's bytes are put together by ``seq``, checked and sketched as a whole, so any
way of cutting gives the same result. Errors are reported by document: invalid UTF-8, an incomplete last
character, no bytes or tokens, more bytes than allowed. Null chunks count as empty; chunks with a null id are left out;
a ``seq`` that comes twice with the same bytes counts once, as a redelivery does.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtext.config import MinHash, SimHash
from loomtext.functions import sketches as S
from loomtext.functions.text import col, mapped, pieces
from loomtext.kernels import sketch

MAX_BYTES = 16 << 20
INVALID, TRAILING, EMPTY = "invalid UTF-8 in stream", "trailing incomplete UTF-8", sketch.EMPTY


def too_long(max_bytes: int) -> str:
    return f"stream exceeds {max_bytes} bytes"


def cut(docs: DataFrame, size: int) -> DataFrame:
    """id, seq, chunk: the bytes of every text in pieces of ``size``; an empty text is one empty piece."""
    data = F.encode("text", "UTF-8")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(data) / size) - 1).cast("int"))
    return docs.filter("text IS NOT NULL").select("id", data.alias("data"), F.explode(parts).alias("seq")).select("id", "seq", F.substring("data", F.col("seq") * size + 1, F.lit(size)).alias("chunk"))


def decoded(data: bytes) -> tuple[str | None, str | None]:
    """Text, or what is wrong with the bytes."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        text = decoder.decode(data)
    except UnicodeDecodeError:
        return None, INVALID
    return (None, TRAILING) if decoder.getstate()[0] else (text, None)


def _gathered(chunks: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """id and parts in order of the documents that fit, and ids of the others: sizes are summed before bytes are, so an overlong document is never gathered."""
    rows = chunks.filter("id IS NOT NULL").select("id", "seq", F.coalesce("chunk", F.lit(b"")).alias("chunk")).dropDuplicates(["id", "seq", "chunk"])
    sizes = rows.groupBy("id").agg(F.sum(F.octet_length("chunk").cast("bigint")).alias("size"))
    fits = rows.join(sizes.filter(F.col("size") <= max_bytes).select("id"), "id", "left_semi")
    whole = fits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    return whole.select("id", F.transform("c", lambda s: s["chunk"]).alias("parts")), sizes.filter(F.col("size") > max_bytes).select("id")


def _read(parts: list[list[bytes]]) -> tuple[list[str | None], list[str | None]]:
    """Texts, and what is wrong with the others."""
    found = [decoded(b"".join(p)) for p in parts]
    return [f[0] for f in found], [f[1] for f in found]


def _each(chunks: DataFrame, max_bytes: int, name: str, kind: str, make: Callable[[list], pa.StructArray]) -> DataFrame:
    """id, ``name``, error of every document; ``make`` gives value and error of whole texts. Bytes are decoded where they are used, in one trip to Python."""
    whole, over = _gathered(chunks, max_bytes)

    @F.arrow_udf(f"struct<{name}: {kind}, error: string>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for parts in pieces(values):
            texts, wrong = _read(parts)
            made = make(texts)
            out.append(pa.StructArray.from_arrays([made.field(0), pc.coalesce(pa.array(wrong, pa.string()), made.field(1))], [name, "error"]))
        return pa.concat_arrays(out)

    lost = over.select("id", F.lit(None).cast(kind).alias(name), F.lit(too_long(max_bytes)).alias("error"))
    return whole.select("id", run("parts").alias("r")).select("id", f"r.{name}", "r.error").unionByName(lost)


def texts(chunks: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, text, error of every document."""
    same = lambda t: pa.StructArray.from_arrays([pa.array(t, pa.string()), pa.nulls(len(t), pa.string())], ["text", "error"])
    return _each(chunks, max_bytes, "text", "string", same)


def minhash_of_chunks(chunks: DataFrame, config: MinHash = MinHash(), max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, sig, error."""
    return _each(chunks, max_bytes, "sig", S.SIGNATURE, lambda t: S.minhashes(t, config))


def simhash_of_chunks(chunks: DataFrame, config: SimHash = SimHash(), max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, sig, error."""
    return _each(chunks, max_bytes, "sig", "bigint", lambda t: S.simhashes(t, config))


class Assembler(StatefulProcessor):
    """Keeps a document's chunks by ``seq`` until its last one (``last``) and all before it are there, then emits its sketch."""

    def __init__(self, config: MinHash | SimHash, max_bytes: int):
        self.config, self.max_bytes = config, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "seq int", "chunk binary")
        self.end = handle.getValueState("end", "seq int, size bigint, failed boolean")

    def _forget(self) -> None:
        self.parts.clear()
        self.end.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, size, failed = self.end.get() if self.end.exists() else (None, 0, False)
        error = None
        for pdf in rows:
            for seq, chunk, final in zip(pdf["seq"], pdf["chunk"], pdf["last"]):
                seq = int(seq)
                last = seq if final else last
                if failed or self.parts.containsKey((seq,)):
                    continue
                chunk = b"" if chunk is None else bytes(chunk)
                size += len(chunk)
                if size > self.max_bytes:  # reported once; what still comes of this document is swallowed
                    error, failed = too_long(self.max_bytes), True
                    self.parts.clear()
                else:
                    self.parts.updateValue((seq,), (chunk,))
        if error:
            yield self._row(key, None, error)
        if last is not None and last >= 0 and (failed or all(self.parts.containsKey((i,)) for i in range(last + 1))):
            if not failed:
                text, error = decoded(b"".join(bytes(self.parts.getValue((i,))[0]) for i in range(last + 1)))
                yield self._row(key, text, error)
            self._forget()
        else:
            self.end.update((None if last is None else int(last), int(size), bool(failed)))

    def _row(self, key: Any, text: str | None, error: str | None) -> pd.DataFrame:
        simple = isinstance(self.config, SimHash)
        sig: Any = None
        if error is None:
            found, some = (sketch.simhash if simple else sketch.minhash)([text], self.config)
            if some[0]:
                sig = int(found.view("int64")[0]) if simple else found[0].view("int64").tolist()
            else:
                error = EMPTY
        return pd.DataFrame({"id": [key[0]], "sig": pd.Series([sig], dtype="Int64" if simple else object), "error": pd.Series([error], dtype=object)})

    def close(self) -> None:
        pass


def sketch_stream(stream: DataFrame, config: MinHash | SimHash = MinHash(), max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, sig (slots, or the SimHash), error of documents in a stream of (id bigint, seq, chunk, last), as they become whole.

    Needs the RocksDB state store. Chunks may come in any order and batch; ``last`` marks the one with the highest ``seq``.
    """
    rows = stream.filter("id IS NOT NULL").select("id", "seq", "chunk", F.coalesce("last", F.lit(False)).alias("last"))
    kind = f"id bigint, sig {'bigint' if isinstance(config, SimHash) else 'array<bigint>'}, error string"
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Assembler(config, max_bytes), outputStructType=kind, outputMode="Append", timeMode="None")


def as_pdf(text: Column | str) -> Column:
    """A one-page PDF file of the text's Latin characters, for trials of extraction."""

    def make(t: str) -> bytes:
        import zlib

        shown = t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\n", b"\\n").replace(b"\r", b"\\r")
        stream = zlib.compress(b"BT /F1 12 Tf 72 720 Td (" + shown + b") Tj ET")
        parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
        parts.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"%%EOF\n"

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return mapped(values, make, pa.binary())

    return run(col(text).cast("string"))
