"""Token ids as Parquet list columns, laid out for selective reads.

Each text becomes the ids of a published byte-level BPE, in a list column that is delta encoded
(DELTA_BINARY_PACKED) or dictionary encoded, as the caller names it. The metadata columns keep dictionaries. Row groups have
GROUP_BYTES, pages PAGE_BYTES, and the files carry page indexes (column and offset index) on doc_id, by which
rows are ordered inside each file, so that a reader that asks for some documents, or for metadata alone,
touches only their pages.

Defined results: a null text has null tokens and n_tokens null; an empty one has an empty list and 0. Repeated
rows and null ids are written as they come. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm._text import encoder, tokenizer_path
from loomtext.session import scratch_path, spread, table

ENCODING, GROUP_BYTES, PAGE_BYTES = "delta", 32 << 20, 256 << 10
SCHEMA = "doc_id bigint, lang string, source string, n_tokens int, tokens array<int>"


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens and tokens of each document; no shuffle."""
    path = tokenizer or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [None if t is None else encode(t) for t in part.column(3).to_pylist()]
                size = np.array([len(x) if x is not None else 0 for x in ids], np.int64)
                null = np.array([x is None for x in ids])
                flat = np.fromiter((t for x in ids if x for t in x), np.int32, int(size.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size.astype(np.int32), mask=null), lists], schema=schema)

    columns = [F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(columns).mapInArrow(run, SCHEMA)


def write_tokens(rows: DataFrame, path: str, encoding: str = ENCODING, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes tokenised rows; ``encoding`` of the ids is ``delta`` or ``dictionary``."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError("encoding must be delta or dictionary")
    writer = (
        rows.sortWithinPartitions("doc_id")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")  # delta encodings where there is no dictionary
        .option("parquet.block.size", group_bytes)
        .option("parquet.page.size.row.check.min", 10)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
    )
    writer.option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower()).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenises and writes the documents, and returns the table as read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(tokenized(spread(table(spark, sf_dir, "documents"))), path)
    return read_tokens(spark, path)
