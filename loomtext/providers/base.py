"""The interface of an embedding provider and its use as a column."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import EmptyEmbedding, LoomError


class Provider(ABC):
    """One object for each partition; it must travel by pickling, so clients and sessions are opened on first use."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""

    @abstractmethod
    def model_id(self) -> str | None: ...

    @abstractmethod
    def dimension(self) -> int: ...

    def embed_document(self, texts: list[str]) -> list[list[float]]:
        return self.embed(texts)

    def embed_query(self, texts: list[str]) -> list[list[float]]:
        return self.embed(texts)


def checked(vector: list[float]) -> list[float]:
    if len(vector) == 0:
        raise EmptyEmbedding
    if not np.isfinite(vector).all():
        raise LoomError("embedding has a number that is not finite")
    return vector


def embedded(rows: DataFrame, provider: Provider, text: str = "text", kind: str = "document", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding`` struct<vector, model_id> and ``error``; null texts have neither.

    A batch that fails is tried again text by text, so an error is told of the text that caused it.
    """
    schema = rows.select("*", F.lit(None).cast("struct<vector: array<float>, model_id: string>").alias("embedding"), F.lit(None).cast("string").alias("error")).schema
    place = rows.columns.index(text)

    def one_by_one(call, texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
        for t in texts:
            try:
                yield checked(call([t])[0]), None
            except (LoomError, IndexError) as e:
                yield None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = {"document": provider.embed_document, "query": provider.embed_query, "plain": provider.embed}[kind]
        vector_type = pa.struct([("vector", pa.list_(pa.float32())), ("model_id", pa.string())])
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                texts = part.column(place).to_pylist()
                some = [t for t in texts if t is not None]
                try:
                    made = [(checked(v), None) for v in call(some)] if some else []
                    if len(made) != len(some):
                        raise LoomError("the provider gave another number of vectors")
                except LoomError:
                    made = list(one_by_one(call, some))
                given = iter(made)
                pairs = [(None, None) if t is None else next(given) for t in texts]
                vectors = pa.array([None if v is None else {"vector": v, "model_id": provider.model_id()} for v, _ in pairs], vector_type)
                yield pa.RecordBatch.from_arrays([*part.columns, vectors, pa.array([e for _, e in pairs], pa.string())], names=[*part.schema.names, "embedding", "error"])

    return rows.mapInArrow(run, schema)
