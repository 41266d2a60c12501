"""Embeddings as columns: checks, norms, products, pooling.

An embedding is struct<vector array<float>, model_id string>. Sums run in double and are returned as floats. Comparisons give
struct<value float, error string>: the error names a model or dimension mismatch, an empty or zero vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.errors import ConfigError
from loomtext.functions.text import col, settled
from loomtext.kernels import pooling

EMBEDDING = "struct<vector: array<float>, model_id: string>"


def embedding(vector: Column | str, model_id: str | None = None, on_error: str = "column") -> Column:
    """struct<embedding, error>; refuses an empty vector and numbers that are null or not finite."""
    v = col(vector).cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    error = F.when(F.size(v) == 0, "empty embedding").when(bad, "embedding has a number that is not finite")
    made = F.when(v.isNotNull() & error.isNull(), F.struct(v.alias("vector"), F.lit(model_id).cast("string").alias("model_id")))
    return settled(F.struct(made.alias("embedding"), error.alias("error")), "embedding", on_error)


def dim(e: Column | str) -> Column:
    return F.size(col(e)["vector"])


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)


def l2_norm(e: Column | str) -> Column:
    v = col(e)["vector"]
    return F.sqrt(_dot(v, v)).cast("float")


def normalize(e: Column | str) -> Column:
    """Length 1; a zero vector stays."""
    c = col(e)
    n = F.sqrt(_dot(c["vector"], c["vector"]))
    return c.withField("vector", F.when(n > 0, F.transform(c["vector"], lambda x: (x / n).cast("float"))).otherwise(c["vector"]))


def mismatch(a: Column | str, b: Column | str) -> Column:
    """Error text or null: models differ if both are named, then dimensions."""
    x, y = col(a), col(b)
    models = x["model_id"].isNotNull() & y["model_id"].isNotNull() & (x["model_id"] != y["model_id"])
    return F.when(models, F.concat(F.lit("model mismatch: "), x["model_id"], F.lit(" vs "), y["model_id"])).when(
        dim(x) != dim(y), F.concat(F.lit("dimension mismatch: "), dim(x).cast("string"), F.lit(" vs "), dim(y).cast("string"))
    )


def _result(value: Column, error: Column, on_error: str) -> Column:
    return settled(F.struct(F.when(error.isNull(), value).cast("float").alias("value"), error.alias("error")), "value", on_error)


def dot(a: Column | str, b: Column | str, on_error: str = "column") -> Column:
    x, y = col(a), col(b)
    return _result(_dot(x["vector"], y["vector"]), mismatch(x, y), on_error)


def cosine(a: Column | str, b: Column | str, on_error: str = "column") -> Column:
    """Not clamped to [-1, 1]."""
    x, y = col(a), col(b)
    nx, ny = _dot(x["vector"], x["vector"]), _dot(y["vector"], y["vector"])
    error = F.coalesce(mismatch(x, y), F.when((nx == 0) | (ny == 0), "zero vector"))
    return _result(_dot(x["vector"], y["vector"]) / F.nullif(F.sqrt(nx) * F.sqrt(ny), F.lit(0.0)), error, on_error)


def embedding_json(e: Column | str) -> Column:
    return F.to_json(col(e), {"ignoreNullFields": "false"})


def embedding_from_json(text: Column | str) -> Column:
    """Null for what is no such object."""
    e = F.from_json(col(text), "vector array<float>, model_id string")
    return F.when(e["vector"].isNotNull(), e)


def pool(hidden: Column | str, hidden_dim: int, mask: Column | str | None = None, how: str = "mean") -> Column:
    """One vector out of a transformer's states, row after row in ``hidden``."""
    if how not in pooling.POOLINGS:
        raise ConfigError(f"no such pooling: {how}")

    @F.arrow_udf("array<float>")
    def run(states: pa.Array, masks: pa.Array) -> pa.Array:
        rows = zip(states.to_pylist(), masks.to_pylist())
        return pa.array([None if h is None else pooling.pool(np.array(h, np.float32), hidden_dim, None if m is None else np.array(m), how) for h, m in rows], pa.list_(pa.float32()))

    m = F.lit(None).cast("array<bigint>") if mask is None else col(mask).cast("array<bigint>")
    return run(col(hidden).cast("array<float>"), m)
