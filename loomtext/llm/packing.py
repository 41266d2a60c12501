"""Packing documents into training windows by non-negative least squares.

A document takes its tokens and one end token. Longer than WINDOW, it is cut into whole windows and a rest.
Piece lengths are counted in units of UNIT tokens, rounded up. All combinations of at most DEPTH lengths that
fill a window exactly are the columns of a matrix, the histogram of lengths its right side; non-negative
least squares gives how often to repeat each. The repeats are rounded down to what the histogram still
holds, and what is left is packed greedily, the largest piece first and the largest that fits after it.

Pieces are numbered within their length and handed to the windows in that order, from counts by length and
shard, so no task sees more than one shard and nothing but the histogram comes to the driver.

Defined results: a null or empty text takes no place. Repeated rows are placed each; a null id stays null.
A piece starts at a multiple of UNIT in its window. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm._fit import small
from loomtext.llm._text import encoder, tokenizer_path
from loomtext.session import spread, table, written

WINDOW, UNIT, DEPTH, SHARD_ROWS = 2048, 16, 4, 1_000_000


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a whole text, null for null."""
    path = tokenizer or tokenizer_path()

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode_ordinary
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


@lru_cache(4)
def combinations(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All falling sequences of at most ``depth`` lengths with sum ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(part: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(part)
            return
        room = depth - len(part)
        if room == 0:
            return
        for x in range(min(left, part[-1] if part else left), (left - 1) // room, -1):
            grow((*part, x), left - x)

    grow((), units)
    return tuple(out)


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 with the least ``|a x - b|``, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ (b - a @ x)
    tol = 1e-10 * max(1.0, np.abs(b).max(initial=0))
    for _ in range(most or 3 * (a.shape[0] + 10)):
        open_ = np.where(passive, -np.inf, slope)
        j = int(np.argmax(open_))
        if open_[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if not len(p) or s.min() > 0:
                break
            bad = s <= 0
            ratio = x[p][bad] / np.maximum(x[p][bad] - s[bad], 1e-300)
            x[p] += ratio.min() * (s - x[p])
            drop = p[(x[p] <= 1e-14) & bad]
            if not len(drop):
                drop = p[bad][[int(np.argmin(ratio))]]
            x[drop] = 0
            passive[drop] = False
        x[:] = 0
        x[p] = s
        slope = a.T @ (b - a @ x)
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of ``histogram`` (pieces by length, from 0) exactly once."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum() == 0:
        return out
    parts = combinations(units, depth)
    a = np.zeros((units, len(parts)))
    for j, part in enumerate(parts):
        for x in part:
            a[x - 1, j] += 1
    share = left[1:] / left.sum()
    repeats = nnls(a, share) * left.sum()
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1 - 1e-9:
            break
        need = a[:, j].astype(np.int64)
        used = need > 0
        times = int(min(np.floor(repeats[j] + 1e-9), (left[1:][used] // need[used]).min()))
        if times > 0:
            left[1:] -= times * need
            out.append((parts[j], times))
    while left.any():
        room, part, trial = units, [], left.copy()
        while room:
            fits = np.flatnonzero(trial[: room + 1])
            if not len(fits):
                break
            part.append(int(fits[-1]))
            trial[fits[-1]] -= 1
            room -= int(fits[-1])
        need = np.bincount(part, minlength=units + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        out.append((tuple(part), times))
    return out


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, tokenizer: str | None = None) -> DataFrame:
    """window_id, start, doc_id, piece, first_token, n_tokens: where each piece of each document goes."""
    if window % unit:
        raise ValueError("the window must be a multiple of the unit")
    spark = docs.sparkSession
    tokens = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text != ''")
    tokens = tokens.select("doc_id", (token_count(F.col("text"), tokenizer) + 1).alias("all"))
    pieces = tokens.select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / window).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(window), F.col("all") - F.col("piece") * window).cast("int").alias("n_tokens"))
    pieces = written(pieces.withColumn("units", F.ceil(F.col("n_tokens") / unit).cast("int")), "pieces")
    histogram = np.zeros(window // unit + 1, np.int64)
    for r in pieces.groupBy("units").count().collect():
        histogram[r["units"]] = r["count"]
    shards = int(histogram.max() // SHARD_ROWS) + 1
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    begins = pieces.groupBy("units", "shard").count()
    before = W.partitionBy("units").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    begins = begins.select("units", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    order = W.partitionBy("units", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "n_tokens")
    ranked = pieces.withColumn("nth", F.row_number().over(order) - 1).join(small(begins), ["units", "shard"])
    ranked = ranked.withColumn("nth", F.col("nth") + F.col("begin"))
    # every slot of every combination takes a run of consecutive numbers of its length
    used, first, rows = np.zeros_like(histogram), 0, []
    for lengths, times in plan(histogram, depth):
        start = 0
        for x in lengths:
            rows.append((int(x), int(used[x]), int(used[x] + times), first, start * unit))
            used[x] += times
            start += x
        first += times
    slots = spark.createDataFrame(rows, "units int, low bigint, high bigint, first bigint, start int")
    slots = slots.groupBy("units").agg(F.collect_list(F.struct("low", "high", "first", "start")).alias("slots"))
    placed = ranked.join(F.broadcast(slots), "units")  # one row for each length in units
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("nth")) & (F.col("nth") < s["high"])), 1)
    placed = placed.withColumn("slot", slot)
    return placed.select(
        (F.col("slot.first") + F.col("nth") - F.col("slot.low")).alias("window_id"),
        F.col("slot.start").alias("start"),
        "doc_id",
        "piece",
        (F.col("piece").cast("bigint") * window).alias("first_token"),
        "n_tokens",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
