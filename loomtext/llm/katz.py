"""Katz backoff language model: fitted on a corpus, stored as a table, evaluated on any documents.

Words are the lowered runs of letters, digits and everything beyond ASCII, known by 48 bits of their hash; an n-gram is
known by 64 bits. All n-grams of the corpus up to ORDER are counted, and the numbers of n-grams that occur once, twice and so on
give the discounts d(r) of counts up to K after Good and Turing (one outside (0, 1) counts as 1). As usual with Katz's
model, n-grams of two words and more enter it from LEAST occurrences on: what occurs once, in the document that is scored
perhaps, is scored as unseen, and its mass goes to backoff.

    P(w | h) = d(c) c / C(h)          if hw is in the model, c = c(hw),
    P(w | h) = alpha(h) P(w | h')     if not,     alpha(h) = left(h) / (1 - sum of P(v | h') over the hv in the model),

where left(h) is the share of C(h), all that follows h, which the hv in the model do not take, so every distribution sums to 1
exactly. A context whose n-grams would keep all its mass gets one count more. The mass that single words leave is
spread evenly over the words not met, their number estimated by Chao's n1 (n1 - 1) / 2 (n2 + 1), so a word never heard of is
less likely than any that was. A word with fewer than ORDER - 1 words before it is scored at the order it has.

Storage: ``ngrams`` is a Parquet table partitioned by order (ord, key, count, total, backoff; total and backoff are those of the n-gram
as a context), ``summary`` has a row for each order (the discounts and the numbers behind them). ``read_model`` opens both.

How it runs: documents become blocks of at most about FLUSH words, written once. For every order each block sends its distinct n-grams, sorted,
packed and already counted, to buckets by the key's high bits; so the most frequent n-gram has one entry for each block,
and no context is ever gathered in one place. Answers come back aligned with what was sent, without keys. Buckets
and blocks grow in number with the text, not in size, and an order's shuffle ends before the next begins.

Defined results: a null, empty or wordless text has n_words 0 and scores null. Rows that repeat an id are
scored each; a null id is reported as null. A model without words gives every word the same small probability. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm._text import U64, Words, blocks, flat, mix
from loomtext.session import drop, drop_path, scratch_path, shuffles_freed, spread, table, written

ORDER, K, LEAST, FLUSH, BUCKET_WORDS = 3, 5, 2, 1_200_000, 1_500_000
_ODD = U64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", 1)
_NGRAMS = "ord int, key bigint, count bigint, total bigint, backoff double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes; integers in their narrowest type, each array compressed where that helps."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu":
            top = int(a.max(initial=0))
            kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
            if 1 << 32 <= top < 1 << 48:  # six bytes: the low four and the high two apart
                a = a.astype("<u8")
                raw, kind = (a & U64(0xFFFFFFFF)).astype("<u4").tobytes() + (a >> U64(32)).astype("<u2").tobytes(), "six"
            else:
                raw = a.astype(kind).tobytes()
        else:
            kind, raw = "<f8", a.astype("<f8").tobytes()
        small_ = _ZSTD.compress(raw, asbytes=True) if raw else raw
        use = len(small_) < 0.95 * len(raw)
        out.append(struct.pack("<3sBQQ", kind.encode(), use, len(a), len(small_ if use else raw)) + (small_ if use else raw))
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, use, n, size = struct.unpack_from("<3sBQQ", data, at)
        at += 20
        raw, at, width = data[at : at + size], at + size, 6 if kind == b"six" else int(kind[2:])
        raw = _ZSTD.decompress(raw, n * width, asbytes=True) if use else raw
        if kind == b"six":
            out.append(np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << U64(32))
        else:
            a = np.frombuffer(raw, kind.decode(), n)
            out.append(a if kind == b"<f8" else a.astype(np.uint64 if width == 8 else np.int64))
    return out


def _pack_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as the first and the steps from one to the next."""
    return keys[:1], np.diff(keys)


def _unpack_keys(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[first.astype(U64), steps.astype(U64)], dtype=U64)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so what is sorted by key is sorted by bucket."""
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _ngrams(word: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams, and the place of each one's last word."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key = np.zeros(m, U64)
    for j in range(n):
        key *= _ODD
        key += word[j : j + m]
        key += U64(1)
    at = np.flatnonzero(place[n - 1 :] >= n - 1)
    return mix(key[at] + U64(n)), at + n - 1


class Grams:
    """The distinct n-grams of a block: sorted keys, and which of them ends at each word (-1: none)."""

    def __init__(self, word: np.ndarray, place: np.ndarray, n: int):
        key, at = _ngrams(word, place, n)
        by = np.argsort(key)
        entry = _runs(key[by])
        self.keys = key[by[entry]]
        self.counts = np.diff(np.r_[entry, len(by)])
        self.first = at[by[entry]]
        self.of = np.full(len(word), -1, np.int32)
        self.of[at[by]] = np.repeat(np.arange(len(entry), dtype=np.int32), self.counts)

    def cuts(self, buckets: int) -> list[tuple[int, int, int]]:
        """Bucket, begin and end of each bucket's keys."""
        if not len(self.keys):
            return []
        b = _bucket_of(self.keys, buckets)
        ends = np.r_[_runs(b), len(b)]
        return [(int(b[i]), int(i), int(j)) for i, j in zip(ends, ends[1:])]


_LISTED = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int32())]))


def word_blocks(docs: DataFrame) -> DataFrame:
    """The documents' words as written blocks: a number, the documents, and the packed word hashes."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("docs", _LISTED), ("words", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            word, counts, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
            held, size = [], 0
            known, code, often = np.unique(word, return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            code = rank[code]
            listed = pa.StructArray.from_arrays([ids, pa.array(counts.astype(np.int32))], ["doc_id", "n_words"])
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), pa.array([len(word)]), pa.array([pack(known[by], code & 0xFFFF, code >> 16)], pa.binary())], schema=schema
            )

        for batch in batches:
            raw, off = flat(batch.column(1))
            for i, j in blocks(off, 1_000_000):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                held.append((words.hash >> U64(16), words.counts, batch.column(0).slice(i, j - i)))
                size += len(words.hash)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    kind = "block bigint, docs array<struct<doc_id: bigint, n_words: int>>, words bigint, data binary"
    return written(source.mapInArrow(run, kind), "blocks")


def _words_of(data: bytes, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and each word's place in its document."""
    known, low, high = unpack(data)
    word = known.astype(U64)[low | high << 16]
    return word, np.arange(len(word)) - np.repeat(np.cumsum(n_words) - n_words, n_words)


def _counts_of(docs: pa.Scalar) -> np.ndarray:
    return docs.values.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sent(parts: DataFrame, n: int, buckets: int, count: bool, last: bool) -> DataFrame:
    """Each block's n-grams by bucket; with ``count`` how often each occurs, and how often at a document's end unless ``last``."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                word, place = _words_of(data.as_buffer().to_pybytes(), _counts_of(docs))
                grams = Grams(word, place, n)
                ending = None
                if count and not last:
                    final = np.flatnonzero(np.r_[place[1:] == 0, True][: len(place)])
                    final = grams.of[final]
                    ending = np.bincount(final[final >= 0], minlength=len(grams.keys))
                rows = []
                for b, i, j in grams.cuts(buckets):
                    columns = [*_pack_keys(grams.keys[i:j])]
                    if count:
                        columns += [grams.counts[i:j] - 1] + ([] if ending is None else [ending[i:j]])
                    rows.append((b, block, pack(*columns)))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 256]), schema)], schema=schema)

    return parts.select("block", "docs", "data").mapInArrow(run, "bucket int, block bigint, data binary")


def _counted(parts: DataFrame, n: int, order: int, least: int, k: int, buckets: int) -> DataFrame:
    """Written rows of three kinds: 0 statistics, 1 the n-grams of the model by bucket, 2 answers to the blocks.

    An answer has, for each n-gram that was sent, the count over all documents if the n-gram is in the model, else 0; and bits for
    those in the model that no block with a smaller number sent.
    """
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("key", pa.list_(pa.int64())), ("count", pa.list_(pa.int64())), ("followed", pa.list_(pa.int64())), ("data", pa.binary())])

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = rows.sort_by("block")
        numbers, parts_ = rows["block"].to_pylist(), [unpack(d) for d in rows["data"].to_pylist()]
        keys = [_unpack_keys(p[0], p[1]) for p in parts_]
        sizes = np.array([len(x) for x in keys])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        entry = _runs(every[by])
        count = np.add.reduceat((np.concatenate([p[2] for p in parts_]) + 1)[by], entry)
        followed = count - np.add.reduceat(np.concatenate([p[3] for p in parts_])[by], entry) if n < order else count * 0
        stats = [int((count == r).sum()) for r in range(1, k + 2)] + [int(count.sum())]
        kept = np.flatnonzero(count >= least)
        out = [(0, bucket, None, None, stats, None, None), (1, bucket, None, every[by[entry[kept]]].view(np.int64), count[kept], followed[kept], None)]
        if n > 1:
            answer, first = np.empty(len(every), np.int64), np.zeros(len(every), bool)
            answer[by] = np.repeat(np.where(count >= least, count, 0), np.diff(np.r_[entry, len(by)]))
            first[by[entry[kept]]] = True
            ends = np.cumsum(sizes)
            out += [(2, bucket, b, None, None, None, pack(answer[e - s : e], np.packbits(first[e - s : e]))) for b, s, e in zip(numbers, sizes, ends)]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    kind = "kind int, bucket int, block bigint, key array<bigint>, count array<bigint>, followed array<bigint>, data binary"
    return written(_sent(parts, n, buckets, True, n == order).groupBy("bucket").applyInArrow(merged, kind), "counts", "kind")


def _links(parts: DataFrame, answers: DataFrame, n: int, last: bool) -> DataFrame:
    """ctx, low, count and (unless ``last``) key of every n-gram of the model, once: its context, itself without its first word, itself."""
    names = ["ctx", "low", "count", *["key"] * (not last)]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        word, place = _words_of(left["data"][0].as_py(), _counts_of(left["docs"][0]))
        grams = Grams(word, place, n)
        right = right.sort_by("bucket")
        answers = [unpack(d) for d in right["data"].to_pylist()]
        count = np.concatenate([a[0] for a in answers])
        own = np.flatnonzero(np.concatenate([np.unpackbits(a[1].astype(np.uint8), count=len(a[0])) for a in answers]))
        key_, at = _ngrams(word, place, n - 1)
        shorter = np.zeros(len(word), U64)
        shorter[at] = key_
        end = grams.first[own]
        columns = [shorter[end - 1], shorter[end], count[own], *[grams.keys[own]] * (not last)]
        return pa.table([pa.array(x.view(np.int64)) for x in columns], names=names)

    return parts.select("block", "docs", "data").groupBy("block").cogroup(answers.select("block", "bucket", "data").groupBy("block")).applyInArrow(run, ", ".join(f"{x} bigint" for x in names))


def discounts(n: list[int], k: int = K) -> list[float]:
    """d(1) to d(k) from the numbers of n-grams that occur 1 to k + 1 times."""
    out = []
    for r in range(1, k + 1):
        d = 1.0
        if n[0] and n[r - 1]:
            common = (k + 1) * n[k] / n[0]
            if common != 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
        out.append(d if 0 < d < 1 else 1.0)
    return out


@dataclass
class Model:
    """The table of n-grams, and by order the discount of each count (0 to K + 1, the last for all above)."""

    order: int
    ngrams: DataFrame
    words: int
    bottom: int
    unknown: float
    discount: list[np.ndarray] = field(default_factory=list)
    path: str = ""


def _summarised(spark: SparkSession, rows: list[tuple[int, list[int], int]], k: int) -> tuple[list[np.ndarray], int, int, float]:
    """Discounts by order, all words, what single words are divided by, and the probability of a word not met."""
    found = {n: (numbers, total) for n, numbers, total in rows}
    order = max(found, default=0)
    discount = [np.zeros(k + 2)] + [np.array([0.0, *discounts(found[n][0], k), 1.0]) for n in range(1, order + 1)]
    if not order or not found[1][1]:
        return discount, 0, 1, 1e-12
    numbers, total = found[1]
    mass = total - sum((1 - discount[1][r]) * r * numbers[r - 1] for r in range(1, k + 1))
    full = mass > total * (1 - 1e-12)
    unseen = max(1.0, numbers[0] * (numbers[0] - 1) / 2 / (numbers[1] + 1))
    left = 1 / (total + 1) if full else 1 - mass / total
    return discount, total, total + 1 if full else total, left / unseen


def _kept(count: Column, discount: np.ndarray) -> Column:
    d = F.array(*[F.lit(float(x)) for x in discount])
    return F.element_at(d, F.least(count, F.lit(len(discount) - 1)).cast("int") + 1) * count


def fit(docs: DataFrame, order: int = ORDER, least: int = LEAST, k: int = K, bucket_words: int = BUCKET_WORDS) -> Model:
    """A model of all documents (doc_id, text), stored in the shared folder."""
    parts = word_blocks(docs)
    model, answers = fit_blocks(parts, order, least, k, bucket_words)
    drop(parts)
    if answers is not None:
        drop(answers)
    return model


def fit_blocks(parts: DataFrame, order: int = ORDER, least: int = LEAST, k: int = K, bucket_words: int = BUCKET_WORDS) -> tuple[Model, DataFrame | None]:
    """The model of documents that are already in blocks, and what it answers the blocks at its highest order (if above 1)."""
    if order < 1 or least < 1:
        raise ValueError("order and least are at least 1")
    spark = parts.sparkSession
    total = parts.agg(F.sum("words")).first()[0] or 0
    buckets = -(-total // bucket_words) or 1
    path = scratch_path(spark, "katz")
    rows: list[tuple[int, list[int], int]] = []
    below = lower = grams = None  # of order n - 1: the written counts, and key_below, count_below and bottom (what the count is divided by)
    for n in range(1, order + 1):
        counted = _counted(parts, n, order, least if n > 1 else 1, k, buckets)
        numbers = [0] * (k + 2)
        for i, x in counted.filter("kind = 0").select(F.posexplode("count").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            numbers[i] = x
        rows.append((n, numbers[:-1], numbers[-1]))
        discount, words, bottom, _ = _summarised(spark, rows, k)
        if bottom != words and words:
            discount[1] = np.r_[0.0, np.ones(k + 1)]  # single words keep all their mass
        shorter, grams = grams, counted.filter("kind = 1").select(F.explode(F.arrays_zip("key", "count", "followed")).alias("g")).select("g.*")
        if n == 1:
            lower = grams.select(F.col("key").alias("key_below"), F.col("count").alias("count_below"), F.lit(bottom).cast("bigint").alias("bottom"))
        else:
            links = written(_links(parts, counted.filter("kind = 2"), n, n == order), "links")
            if n < order:
                drop_path(spark, f"{counted._written_at}/kind=2")
            p = _kept(F.col("count_below"), discount[n - 1]) / F.col("bottom")
            sums = links.select("ctx", "low", "count").join(lower, F.col("low") == F.col("key_below")).select("ctx", _kept(F.col("count"), discount[n]).alias("kept"), p.alias("p"))
            sums = written(sums.groupBy("ctx").agg(F.sum("kept").alias("kept"), F.sum("p").alias("taken")), "sums")
            if n > 2:
                drop(lower)
            contexts = shorter.join(sums, shorter.key == sums.ctx, "left").withColumn("full", F.col("kept") > F.col("followed") * (1 - 1e-12))
            contexts = contexts.withColumn("total", F.col("followed") + F.coalesce(F.col("full").cast("int"), F.lit(0)))
            left = F.when(F.col("full"), 1 / F.col("total")).otherwise(1 - F.col("kept") / F.col("total"))
            contexts = contexts.select("key", "count", "total", F.coalesce(left / F.greatest(1 - F.col("taken"), F.lit(1e-300)), F.lit(1.0)).alias("backoff"))
            with shuffles_freed(spark):
                contexts.write.option("compression", "zstd").parquet(f"{path}/ngrams/ord={n - 1}")
            drop(sums)
            drop(below)
            if n < order:
                stored = spark.read.schema("key bigint, count bigint, total bigint, backoff double").parquet(f"{path}/ngrams/ord={n - 1}")
                stored = stored.filter("total > 0").select(F.col("key").alias("of"), F.col("total").alias("bottom"))
                own = links.join(stored, F.col("ctx") == F.col("of"))
                lower = written(own.select(F.col("key").alias("key_below"), F.col("count").alias("count_below"), "bottom"), "lower")
            drop(links)
        below = counted
    grams.select("key", "count", F.lit(0).cast("bigint").alias("total"), F.lit(1.0).alias("backoff")).write.option("compression", "zstd").parquet(f"{path}/ngrams/ord={order}")
    drop_path(spark, f"{below._written_at}/kind=1")
    summary = spark.createDataFrame([(n, numbers, occurrences, [float(x) for x in discount[n]]) for n, numbers, occurrences in rows], "ord int, numbers array<bigint>, occurrences bigint, discounts array<double>")
    summary.coalesce(1).write.parquet(f"{path}/summary")
    return read_model(spark, path), below if order > 1 else None


def read_model(spark: SparkSession, path: str) -> Model:
    """A stored model."""
    rows = sorted((r["ord"], list(r["numbers"]), r["occurrences"]) for r in spark.read.parquet(f"{path}/summary").collect())
    discount, words, bottom, unknown = _summarised(spark, rows, len(rows[0][1]) - 1)
    return Model(len(rows), spark.read.schema(_NGRAMS).parquet(f"{path}/ngrams"), words, bottom, unknown, discount, path)


def _model_rows(model: Model, n: int, buckets: int) -> DataFrame:
    """The model's n-grams by bucket, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            key, count, total, backoff = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(4))
            held.clear()
            key = key.view(U64)
            by = np.argsort(key)
            key, count, total, backoff = key[by], count[by], total[by], backoff[by]
            b = _bucket_of(key, buckets)
            ends = np.r_[_runs(b), len(b)]
            out = [(int(b[i]), pack(*_pack_keys(key[i:j]), count[i:j], total[i:j], backoff[i:j])) for i, j in zip(ends, ends[1:])]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1_000_000:
                yield flush()
        if sum(b.num_rows for b in held):
            yield flush()

    return model.ngrams.filter(F.col("ord") == n).select("key", "count", "total", "backoff").mapInArrow(run, "bucket int, data binary")


def _looked_up(parts: DataFrame, model: Model, n: int, buckets: int) -> DataFrame:
    """By block and bucket what the model has of the block's n-grams: counts, and for the shorter orders totals and backoffs."""
    schema = pa.schema([("ord", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
    last = n == model.order

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = [unpack(d) for d in right["data"].to_pylist()]
        have = np.concatenate([_unpack_keys(h[0], h[1]) for h in held]) if held else np.zeros(0, U64)
        by = np.argsort(have)
        have = have[by]
        count, total, backoff = (np.concatenate([h[i] for h in held])[by] if held else have for i in (2, 3, 4))
        out = []
        for block, data in zip(left["block"].to_pylist(), left["data"].to_pylist()):
            asked = _unpack_keys(*unpack(data))
            at = np.minimum(np.searchsorted(have, asked), max(len(have) - 1, 0))
            hit = have[at] == asked if len(have) else np.zeros(len(asked), bool)
            own = np.zeros((2, len(asked)), np.int64)
            alpha = np.ones(len(asked))
            own[:, hit], alpha[hit] = (count[at[hit]], total[at[hit]]), backoff[at[hit]]
            odd = alpha != 1
            out.append((n, key[0].as_py(), block, pack(own[0]) if last else pack(own[0], own[0] + 1 - own[1], np.packbits(odd), alpha[odd])))
        return pa.table([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)

    rows = _model_rows(model, n, buckets)
    return _sent(parts, n, buckets, False, True).groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, "ord int, bucket int, block bigint, data binary")


def score(docs: DataFrame, model: Model, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, logprob (natural) and its mean by word, for every document."""
    return score_blocks(word_blocks(docs), model, None, bucket_words)


def score_blocks(parts: DataFrame, model: Model, answers: DataFrame | None = None, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The scores of documents in blocks; ``answers`` are those of :func:`fit_blocks` if the model was fitted on the same blocks."""
    spark = parts.sparkSession
    buckets = -(-max(parts.agg(F.sum("words")).first()[0] or 0, model.words) // bucket_words) or 1
    found = None if answers is None else answers.filter("kind = 2").select(F.lit(model.order).alias("ord"), "bucket", "block", "data")
    for n in range(1, model.order + (answers is None)):
        own = written(_looked_up(parts, model, n, buckets), "found")
        found = own if found is None else found.unionByName(own)
    order, discount, bottom, unknown = model.order, model.discount, model.bottom, model.unknown
    if bottom != model.words:  # single words keep all their mass
        discount = [discount[0], *([np.r_[0.0, np.ones(len(discount[1]) - 1)]] if order else []), *discount[2:]]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left["docs"][0].values
        n_words = docs.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        word, place = _words_of(left["data"][0].as_py(), n_words)
        right = right.sort_by([("ord", "ascending"), ("bucket", "ascending")])
        answers: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for n, data in zip(right["ord"].to_pylist(), right["data"].to_pylist()):
            answers[n].append(unpack(data))
        p = total = alpha = None
        for n in range(1, order + 1):
            grams = Grams(word, place, n)
            if not len(grams.keys):
                break
            count = np.concatenate([a[0] for a in answers[n]])
            kept = discount[n][np.minimum(count, len(discount[n]) - 1)] * count
            here = np.flatnonzero(grams.of >= 0)
            own = kept[grams.of[here]]
            if n == 1:
                p = np.where(own > 0, own / bottom, unknown)
            else:
                # total and alpha stand at the last word of each context
                p[here] = np.where(own > 0, own / np.maximum(total[here - 1], 1), alpha[here - 1] * p[here])
            if n < order:
                totals = count + 1 - np.concatenate([a[1] for a in answers[n]])
                backoff = np.ones(len(totals))
                odd = np.concatenate([np.unpackbits(a[2].astype(np.uint8), count=len(a[0])) for a in answers[n]]).astype(bool)
                backoff[odd] = np.concatenate([a[3] for a in answers[n]])
                total, alpha = np.ones(len(word), np.int64), np.ones(len(word))
                total[here], alpha[here] = totals[grams.of[here]], backoff[grams.of[here]]
        value = np.zeros(len(n_words))
        some = n_words > 0
        if some.any():
            value[some] = np.add.reduceat(np.log(p), (np.cumsum(n_words) - n_words)[some])
        mean = value / np.maximum(n_words, 1)
        return pa.table([docs.field(0), docs.field(1), pa.array(value, mask=~some), pa.array(mean, mask=~some)], names=["doc_id", "n_words", "logprob", "mean_logprob"])

    left = parts.select("block", "docs", "data").groupBy("block")
    if found is None:
        found = spark.createDataFrame([], "ord int, bucket int, block bigint, data binary")
    return left.cogroup(found.groupBy("block")).applyInArrow(run, "doc_id bigint, n_words int, logprob double, mean_logprob double")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the model of all documents."""
    parts = word_blocks(spread(table(spark, sf_dir, "documents")))
    model, answers = fit_blocks(parts)
    out = score_blocks(parts, model, answers)
    drop_path(spark, model.path)  # what the scores need of it has been looked up
    return out.select("doc_id", "n_words", F.round("logprob", 4).alias("logprob"), F.round("mean_logprob", 6).alias("mean_logprob"))


def _discounted(n: int) -> str:
    common = f"({K + 1} * n{K + 1}::DOUBLE / n1)"
    cases = " ".join(f"WHEN {r} THEN (({r + 1} * n{r + 1}::DOUBLE / n{r} / {r} - {common}) / (1 - {common}))" for r in range(1, K + 1))
    return f"SELECT *, CASE WHEN d > 0 AND d < 1 THEN d ELSE 1 END * c AS k FROM (SELECT *, CASE WHEN c <= {K} THEN CASE c {cases} END ELSE 1 END AS d FROM g{n}, (SELECT {_N} FROM g{n}))"


_N = ", ".join(f"nullif(count(*) FILTER (c = {r}), 0) AS n{r}" if r <= K else f"count(*) FILTER (c = {r}) AS n{r}" for r in range(1, K + 2))

#: The trigram model, word by word.
SQL = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, len(ws) AS n, unnest(ws) AS w
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents)
), runs AS MATERIALIZED (
  SELECT doc_id, n, i, lag(w, 2) OVER o AS u, lag(w) OVER o AS v, w FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g1 AS (SELECT w, count(*) AS c, count(*) FILTER (i < n) AS f FROM runs GROUP BY ALL),
g2 AS (SELECT v, w, count(*) AS c, count(*) FILTER (i < n) AS f FROM runs WHERE v IS NOT NULL GROUP BY ALL),
g3 AS (SELECT u, v, w, count(*) AS c FROM runs WHERE u IS NOT NULL GROUP BY ALL),
k1 AS ({_discounted(1)}), k2 AS ({_discounted(2)}), k3 AS ({_discounted(3)}),
mass AS (SELECT sum(c) AS t, sum(k) AS m, sum(k) > sum(c) * (1 - 1e-12) AS whole FROM k1),
p1 AS MATERIALIZED (SELECT w, f, CASE WHEN whole THEN c / (t + 1) ELSE k / t END AS p FROM k1, mass),
s1 AS MATERIALIZED (
  SELECT a.v, any_value(b.f) AS f, sum(k) > any_value(b.f) * (1 - 1e-12) AS whole, sum(k) AS m, sum(p1.p) AS taken
  FROM k2 a JOIN p1 ON p1.w = a.w JOIN p1 b ON b.w = a.v WHERE a.c >= {LEAST} GROUP BY a.v
), p2 AS MATERIALIZED (SELECT v, w, k2.f, k / (s1.f + whole::INT) AS p FROM k2 JOIN s1 USING (v) WHERE c >= {LEAST}),
s2 AS MATERIALIZED (
  SELECT a.u, a.v, any_value(b.f) AS f, sum(k) > any_value(b.f) * (1 - 1e-12) AS whole, sum(k) AS m, sum(p2.p) AS taken
  FROM k3 a JOIN p2 ON p2.v = a.v AND p2.w = a.w JOIN p2 b ON b.v = a.u AND b.w = a.v WHERE a.c >= {LEAST} GROUP BY a.u, a.v
), p3 AS MATERIALIZED (SELECT u, v, w, k / (s2.f + whole::INT) AS p FROM k3 JOIN s2 USING (u, v) WHERE c >= {LEAST}),
a1 AS MATERIALIZED (SELECT v, CASE WHEN whole THEN 1 / (f + 1) ELSE 1 - m / f END / (1 - taken) AS a FROM s1),
a2 AS MATERIALIZED (SELECT u, v, CASE WHEN whole THEN 1 / (f + 1) ELSE 1 - m / f END / (1 - taken) AS a FROM s2),
scored AS (
  SELECT doc_id, coalesce(p3.p, coalesce(a2.a, 1) * coalesce(p2.p, coalesce(a1.a, 1) * p1.p)) AS p
  FROM runs x JOIN p1 ON p1.w = x.w
  LEFT JOIN p2 ON p2.v = x.v AND p2.w = x.w LEFT JOIN p3 ON p3.u = x.u AND p3.v = x.v AND p3.w = x.w
  LEFT JOIN a1 ON a1.v = x.v LEFT JOIN a2 ON a2.u = x.u AND a2.v = x.v
), sums AS (SELECT doc_id, count(*) AS n, sum(ln(p)) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INTEGER AS n_words, round(s, 4) AS logprob, round(s / n, 6) AS mean_logprob
FROM documents LEFT JOIN sums USING (doc_id)
"""
