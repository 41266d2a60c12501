"""Relational forms of the sketches: unions, document frequencies, weighted SimHash, Hamming search."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.config import SCHEMA, WORDS, Canonical, SimHash, Tokens
from loomtext.errors import ConfigError
from loomtext.functions.sketches import hamming, hash_tokens, merge_signatures
from loomtext.functions.text import pieces, tokens
from loomtext.kernels.hashing import hash128
from loomtext.kernels.sketch import counted, simhash_bits


def union_signatures(rows: DataFrame, by: str, sig: str, slots: int) -> DataFrame:
    """Signature of the union of each group's documents: the unsigned minimum by slot. Null signatures add nothing."""
    top = F.lit(-(1 << 63)).cast("bigint")
    merged = rows.filter(F.col(sig).isNotNull()).groupBy(by).agg(*merge_signatures(sig, slots))
    return merged.select(by, F.struct(F.lit(SCHEMA).cast("smallint").alias("schema"), F.array(*[F.col(f"m{i}").bitwiseXOR(top) for i in range(slots)]).alias("hashes")).alias(sig))


def document_frequency(docs: DataFrame, config: Tokens = WORDS, canonical: Canonical = Canonical()) -> DataFrame:
    """token, df: how many documents have it. Null texts count for nothing."""
    own = docs.select(F.explode(F.array_distinct(tokens("text", config, canonical))).alias("token"))
    return own.groupBy("token").agg(F.count("*").alias("df"))


def idf_table(docs: DataFrame, config: Tokens = WORDS, canonical: Canonical = Canonical()) -> DataFrame:
    """token, idf = log(N / df) as a float, N the documents that have tokens."""
    lists = docs.select(F.monotonically_increasing_id().alias("d"), tokens("text", config, canonical).alias("t"))
    total = lists.filter(F.size("t") > 0).agg(F.count("*").alias("n"))
    df = document_frequency(docs, config, canonical)
    return df.crossJoin(F.broadcast(total)).select("token", F.log(F.col("n") / F.col("df")).cast("float").alias("idf"))


def last_wins(pairs: DataFrame, order: str) -> DataFrame:
    """token, idf: of repeated tokens the one with the largest ``order``."""
    return pairs.groupBy("token").agg(F.max_by("idf", order).alias("idf"))


def _term_counts(text: str, config: SimHash) -> Column:
    """lo, hi and tf of each different token of a text."""

    def made(texts: list) -> list[pa.Array]:
        out = []
        for _, _, group, tf, off in counted(texts, config):
            halves = [pa.array(h.view(np.int64)) for h in hash128(group, config.family, config.seed)]
            out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays([*halves, pa.array(tf)], ["lo", "hi", "tf"])))
        return out

    @F.arrow_udf("array<struct<lo: bigint, hi: bigint, tf: bigint>>")
    def run(values: pa.Array) -> pa.Array:
        found = [a for texts in pieces(values) for a in made(texts)]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("tf", pa.int64())]))
        return pa.concat_arrays(found) if found else pa.array([], kind)

    return run(F.col(text).cast("string"))


def _weights(tf: Column, idf: Column) -> Column:
    """As the kernel's ``weights``."""
    w = tf.cast("float") * idf
    bounded = F.greatest(F.lit(-1e15), F.least(F.lit(1e15), w.cast("double"))).cast("bigint")
    return F.when(F.isnan(w) | (F.abs(w) == float("inf")), F.lit(1).cast("bigint")).otherwise(bounded)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and simhash of rows (id, lo, w) that are sorted by id."""
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        names = rows["id"].combine_chunks()
        places = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begin = np.r_[0, np.flatnonzero(np.diff(places)) + 1]
        off = np.r_[begin, rows.num_rows] if last else begin  # the last document may go on
        done = pa.array(off[:-1])
        bits = simhash_bits(rows["lo"].to_numpy()[: off[-1]].view(np.uint64), off, rows["w"].to_numpy()[: off[-1]])
        return pa.RecordBatch.from_arrays([names.take(done), pa.array(bits.view(np.int64))], names=["id", "simhash"]), rows.slice(int(off[-1])).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 16 and len(held) > 1:
            out, held = made(pa.Table.from_batches(held), False)
            yield out
    if sum(b.num_rows for b in held):
        yield made(pa.Table.from_batches(held), True)[0]


def simhash_by_idf(docs: DataFrame, idf: DataFrame, config: SimHash = SimHash(weighting="idf")) -> DataFrame:
    """id, simhash by a table of weights of any size: term counts joined with it, then summed for each document.

    Tokens are told apart by their 128-bit hashes. A document's terms are shuffled twice as these and a number, to their weights and back; sums are taken where all
    terms of a document are, as partial ones of 64 numbers would be many times as large. An id that comes twice counts as one document.
    """
    if config.weighting != "idf":
        raise ConfigError("this form is for idf weights")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, 4 * docs.rdd.getNumPartitions(), 4 * idf.rdd.getNumPartitions())
    terms = docs.select(F.col("id"), F.explode(_term_counts("text", config)).alias("t")).select("id", "t.lo", "t.hi", "t.tf").repartition(parts, "lo", "hi")
    if not docs.groupBy("id").count().filter("count > 1").isEmpty():
        terms = terms.groupBy("id", "lo", "hi").agg(F.sum("tf").alias("tf"))
    known = idf.filter("token IS NOT NULL").select(hash_tokens(F.array("token"), config.family, config.seed)[0].alias("h"), F.col("idf").cast("float").alias("__idf"))
    known = known.select(F.col("h.low").alias("lo"), F.col("h.high").alias("hi"), "__idf").repartition(parts, "lo", "hi").hint("shuffle_hash")
    rows = terms.join(known, ["lo", "hi"], "left").select("id", "lo", _weights(F.col("tf"), F.coalesce("__idf", F.lit(1.0).cast("float"))).alias("w"))
    kind = f"id {docs.schema['id'].dataType.simpleString()}, simhash bigint"
    return rows.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(_prints, kind)


def _choices(most: int, extra: int) -> list[int]:
    """Masks of all choices of ``extra`` of most + extra blocks of 64 bits."""
    edges = [round(i * 64 / (most + extra)) for i in range(most + extra + 1)]
    return [sum((1 << hi) - (1 << lo) for lo, hi in chosen) for chosen in itertools.combinations(list(zip(edges, edges[1:])), extra)]


def _bucket_pairs(v: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within the buckets [begin, end) that are at most ``most`` bits apart."""
    large = end - begin > 512
    for a, b in zip(begin[large].tolist(), end[large].tolist()):
        for i in range(a, b - 1):
            j = np.flatnonzero(np.bitwise_count(v[i + 1 : b] ^ v[i]) <= most)
            if len(j):
                yield np.full(len(j), i), j + i + 1
    sizes = (end - begin)[~large]
    live = np.repeat(begin[~large] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    last = np.repeat(end[~large], sizes)
    for step in itertools.count(1):
        more = live + step < last
        live, last = live[more], last[more]
        if not len(live):
            return
        close = live[np.bitwise_count(v[live] ^ v[live + step]) <= most]
        yield close, close + step


def _close(masks: list[int], most: int):  # noqa: ANN202
    """Of rows (block, key, simhash) sorted by the former two: x, y of the pairs that meet in a bucket and are close, in the first block alone where they meet."""
    every = np.array(masks, np.uint64)

    def found(rows: pa.Table, last: bool) -> tuple[Iterator[pa.RecordBatch], list[pa.RecordBatch]]:
        block, key, v = (rows[c].to_numpy() for c in ("block", "key", "simhash"))
        edge = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (key[1:] != key[:-1])) + 1, len(v)]
        edge = edge if last else edge[:-1]  # the last bucket may go on
        v = v.view(np.uint64)
        many = np.diff(edge) > 1

        def batches() -> Iterator[pa.RecordBatch]:
            xs, ys, held = [], [], 0
            for i, j in itertools.chain(_bucket_pairs(v, edge[:-1][many], edge[1:][many], most), [(None, None)]):
                if i is not None:
                    first = np.argmax((v[i] ^ v[j])[:, None] & every == 0, axis=1) == block[i]
                    xs.append(v[i[first]].view(np.int64))
                    ys.append(v[j[first]].view(np.int64))
                    held += len(xs[-1])
                if xs and (i is None or held >= 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])
                    xs, ys, held = [], [], 0

        return batches(), rows.slice(int(edge[-1])).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, 1 << 16
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                out, held = found(pa.Table.from_batches(held), False)
                yield from out
                size = sum(b.num_rows for b in held)
                enough = max(1 << 16, 2 * size)
        if size:
            yield from found(pa.Table.from_batches(held), True)[0]

    return run


def hamming_pairs(prints: DataFrame, most: int) -> DataFrame:
    """a < b and distance of all fingerprints (id, simhash) at most ``most`` bits apart; exact.

    Of most + e blocks of their bits two such fingerprints agree on e, so they are brought together by all choices of e blocks and compared there; e is the least
    (of 3 at most) with 6 more bits in a choice than it takes to number the fingerprints: those of texts in one language have many bits in common, so a choice tells
    fewer apart than its bits say. A pair is handed on by the first choice it meets in. Equal fingerprints are folded into one before. Null ids and fingerprints match nothing; ids must be unique.
    """
    if not 0 <= most < 64:
        raise ConfigError("the distance lies in [0, 64)")
    spark = prints.sparkSession
    live = prints.filter("id IS NOT NULL AND simhash IS NOT NULL").select("id", "simhash")
    values = live.select("simhash").distinct()
    n = values.count()
    extra = next((e for e in (1, 2) if 64 * e / (most + e) >= n.bit_length() + 6 or most + e >= 8), 3 if most < 5 else 1)
    masks = _choices(most, extra)
    cut = [F.col("simhash").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")) for m in masks]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, n * len(masks) // 500_000)
    blocks = values.select("simhash", F.posexplode(F.array(*cut)).alias("block", "key")).select("block", "key", "simhash")
    close = blocks.repartition(parts, "block", "key").sortWithinPartitions("block", "key").mapInArrow(_close(masks, most), "x bigint, y bigint")
    close = close.unionByName(values.select(F.col("simhash").alias("x"), F.col("simhash").alias("y")))
    a = live.select(F.col("id").alias("i"), F.col("simhash").alias("x"))
    b = live.select(F.col("id").alias("j"), F.col("simhash").alias("y"))
    both = close.join(a, "x").join(b, "y").filter("i != j AND (x != y OR i < j)")
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming("x", "y").alias("distance"))
