"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of lowered words (letters, digits and everything beyond ASCII). Every run
of K words is labelled with how often it occurred before in the same document. For each of BANDS hash
functions the PICK labelled runs with the smallest hashes are taken and kept in text order; documents
that agree on such a tuple are candidates. Because order and occurrence count, agreement follows edit
similarity, not mere overlap.

Equal word sequences are folded into one node first, so that a passage copied a million times
is one node. Within a bucket of the others every member is aligned with the bucket's leader (the
smallest node under a hash that differs by band); those that fail are led by one of themselves in the next
round. After ROUNDS rounds the pairs of each bucket that are not connected yet, passed or failed, are
compared: those whose words, counted in BINS bins, have too little in common to be near are left out by products of whole blocks of
such counts, the others are aligned. So nothing is capped, a bucket of n copies near to their leader costs n alignments, and
one of n unlike texts around a common sentence costs n rows of counts and n^2 short products, but no rows or alignments for each pair.
Accepted pairs have 1 - distance / longer length >= SIMILARITY,
the distance counting inserted, deleted and replaced words. Groups are the connected components.

Defined results: a null or wordless text and a null id belong to no group. With fewer than K words the
whole text is the one run; with fewer than PICK runs all are taken. Every row is a document of its own, also where rows repeat
an id or a whole row; group_id is the group's smallest id, and the one row that is kept has it (of several, the one whose
words have the smallest digest). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm._components import components
from loomtext.llm._fit import small
from loomtext.llm._text import U64, Words, blocks, flat, mix, signed
from loomtext.session import drop, spread, table, written

#: Runs of three words and 72 bands: a pair at just SIMILARITY with scattered replacements shares a bucket with chance 1 - (1 - (0.343 / 1.657)^2)^72 = 0.96,
#: while unlike texts seldom do, so buckets don't grow with the corpus.
K, PICK, BANDS, SIMILARITY, ROUNDS = 3, 2, 72, 0.7, 3
#: Bins that words are counted in, counts told apart (above, only their sum), and members of a bucket that one task holds at once, of which it multiplies a block.
BINS, LEVELS, CHUNK, BLOCK = 256, 4, 65_536, 2048


def _labelled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every labelled run, and its document; short documents give one run."""
    value, at = words.grams(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        begin = words.first[short]
        total = np.array([mix(np.cumsum(words.hash[b : b + n])[-1:] + U64(n))[0] for b, n in zip(begin, words.counts[short])], U64)
        value, doc, at = np.r_[value, total], np.r_[doc, short], np.r_[at, begin]
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    own = value ^ mix(doc.astype(U64) + U64(77))
    order = np.argsort(own, kind="stable")
    run = own[order]
    fresh = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    began = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
    nth = np.empty(len(run), np.int64)
    nth[order] = np.arange(len(run)) - began
    return mix(value + nth.astype(U64) * U64(0xD6E8FEB86659FD93)), doc


def sketch(words: Words, k: int = K, pick: int = PICK, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have words, and a row of band keys for each."""
    value, doc = _labelled(words, k)
    if not len(value):
        return np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[begin, len(doc)])
    index = (np.arange(len(doc)) - np.repeat(begin, counts)).astype(U64)
    bits = U64(max(24, int(counts.max()).bit_length()))
    top = ~((U64(1) << bits) - U64(1))
    low = ~top
    keys = np.empty((len(begin), bands), U64)
    for band in range(bands):
        mixed = mix(value ^ U64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        mixed = (mixed & top) | index  # the place in the text rides in the low bits
        places = np.full((len(begin), pick), np.iinfo(np.int64).max)
        for j in range(pick):
            best = np.minimum.reduceat(mixed, begin)
            place = (best & low).astype(np.int64)
            used = counts > j
            places[used, j] = place[used]
            mixed[begin[used] + place[used]] = U64((1 << 64) - 1)
        places.sort(axis=1)
        key = np.zeros(len(begin), U64)
        for j in range(pick):
            there = counts > j
            key[there] = mix(key[there] * U64(31) + value[begin[there] + places[there, j]] + U64(band))
        keys[:, band] = key
    return doc[begin], signed(keys)


def _sketches(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text_hash, text) that have words: a digest of the whole word sequence, the band keys, and the words as 32-bit hashes."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("whole", pa.string()), ("bands", pa.list_(pa.int64())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            for i, j in blocks(off, 2_000_000):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                rows, keys = sketch(words)
                if not len(rows):
                    continue
                place = words.index.astype(U64)
                begin = words.first[rows]
                pair = [np.add.reduceat(mix(words.hash ^ mix(place + U64(s))), begin) for s in (1, 1 << 40)]
                whole = [f"{a:016x}{b:016x}" for a, b in zip(*pair)]
                flat_keys = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                short = (words.hash >> U64(32)).astype(np.uint32)
                lists = pa.array([short[a:b].tobytes() for a, b in zip(begin, begin + words.counts[rows])], pa.binary())
                own = [batch.column(c).slice(i, j - i).take(pa.array(rows)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(whole), flat_keys, lists], schema=schema)

    return docs.select("id", "text_hash", "text").mapInArrow(run, "id bigint, text_hash bigint, whole string, bands array<bigint>, words binary")


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most + 1``.

    Only the cells within ``most`` of the diagonal exist: a row of the alignment is a pair of bit vectors
    as wide as that band (vertical steps up and down), moved one place along at every row.
    """
    if len(a) < len(b):
        a, b = b, a
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if m == 0:
        return n
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    band = min(max(n - m, 8), most)
    while True:
        found = _in_band(a, m, where, band)
        if found <= band or band == most:
            return min(found, most + 1)
        band = min(4 * band, most)


def _in_band(a: list, m: int, where: dict, band: int) -> int:
    """The distance if at most ``band`` (at least the difference in length), else something larger.

    A column of the alignment is two bit vectors, the vertical steps up and down, as wide as the band and
    moved down by one place at each element of ``a``; bit t of column i stands for row i - band + t.
    """
    n = len(a)
    full = (1 << 2 * band + 1) - 1
    up, down, score = full >> band << band, 0, 0
    for i in range(1, n + 1):
        shift = i - band - 1
        eq = where.get(a[i - 1], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if i <= m:
            score += not diagonal >> band & 1
            if score > band + n - m:
                return band + 1
        else:
            at = m - i + band
            score += (right_up >> at & 1) - (right_down >> at & 1)
        up = (right_down | ~(diagonal >> 1 | right_up)) & full
        down = diagonal >> 1 & right_up
    return score


def allowed(longer: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * longer + 1e-9)


def _foreign(a: list, b: list) -> int:
    """How many elements of ``a`` are nowhere in ``b``: none of these goes without an edit."""
    return len(a) - sum(map(set(b).__contains__, a))


def _aligned(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """pairs (a, b) with whether their alignment is close enough, and its distance."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, score = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint32).tolist() for z in (x, y))
                longer = max(len(u), len(v), 1)
                most = allowed(longer)
                if _foreign(u, v) > most or _foreign(v, u) > most:
                    near.append(False)
                    score.append(None)
                    continue
                d = banded_distance(u, v, most)
                near.append(d <= most)
                score.append(1 - d / longer if d <= most else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_()), pa.array(score, pa.float64())], schema=schema)

    both = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint, near boolean, similarity double")


def _prints(words: DataFrame) -> DataFrame:
    """id, n (words) and print: the counts of the words in BINS bins, none above 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]
            counts = [np.minimum(np.bincount(x % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lists], pa.int32()), pa.array(counts, pa.binary())], names=["id", "n", "print"])

    return words.select("id", "words").mapInArrow(run, "id bigint, n int, print binary")


def _unary(prints: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows whose products are at least the number of words that two texts have in common, as a multiset."""
    steps = [prints >= t for t in range(1, LEVELS + 1)]
    over = np.sqrt(np.maximum(n - np.minimum(prints, LEVELS).sum(axis=1, dtype=np.int64), 0))
    return np.c_[(*steps, over)].astype(np.float32)


def _may_be_near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Which rows of two sets of counts may belong to near texts: an alignment keeps no more words than both have."""
    longer = np.maximum(nx[:, None], ny[None, :])
    least = longer - np.floor((1 - SIMILARITY) * longer + 1e-9)
    return (np.minimum(nx[:, None], ny[None, :]) >= least) & (_unary(x, nx) @ _unary(y, ny).T >= least - 0.01)


def _apart(members: DataFrame, edges: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket that ``edges`` don't connect and whose words have enough in common for them to be near."""
    roots = components(edges).select(F.col("node").alias("id"), "root")
    known = written(members.join(roots, "id", "left").select("band", "key", "id", F.coalesce("root", "id").alias("root")), "known")
    # the largest component of a bucket meets the others, never itself
    parts = known.groupBy("band", "key", "root").count().groupBy("band", "key").agg(F.max(F.struct("count", "root")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("size"))
    parts = parts.filter("parts > 1").select("band", "key", F.col("main.root").alias("main"), F.ceil(F.col("size") / CHUNK).alias("chunks"))
    split = known.join(parts, ["band", "key"]).select("band", "key", "id", "root", (F.col("root") == F.col("main")).alias("most"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("own"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other"))
    split = split.join(_prints(words), "id").select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "root", "most", "n", "print")

    def pairs(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, root, most, n, own, x, y = (unit[c].to_numpy() for c in ("id", "root", "most", "n", "own", "x", "y"))
        n = n.astype(np.int64)
        prints = np.frombuffer(b"".join(unit["print"].to_pylist()), np.uint8).reshape(-1, BINS)
        one, two = own == x[0], own == y[0]
        few = np.flatnonzero(one & ~most)
        if x[0] == y[0]:
            jobs = [(few, np.r_[few, np.flatnonzero(most)], True)]
        else:
            jobs = [(few, np.flatnonzero(two), False), (np.flatnonzero(one & most), np.flatnonzero(two & ~most), False)]
        for left, right, same in jobs:
            for s in range(0, len(left), BLOCK):
                u = left[s : s + BLOCK]
                for t in range(s if same else 0, len(right), BLOCK):
                    v = right[t : t + BLOCK]
                    i, j = np.nonzero(_may_be_near(prints[u], prints[v], n[u], n[v]) & (root[u][:, None] != root[v][None, :]))
                    if len(i):
                        a, b = ids[u[i]], ids[v[j]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = [], None  # a unit may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("band", "key", "x", "y")]
            turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in names])) + 1
            for begin, end in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                this = tuple(c[begin] for c in names)
                if kept and this != last:
                    yield from pairs(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(begin, end - begin))
                last = this
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    units = split.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y")
    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def _led(members: DataFrame) -> DataFrame:
    """``members`` (band, key, id) of buckets of two and more, with their leaders."""
    bucket = W.partitionBy("band", "key")
    leader = F.min(F.struct(F.xxhash64("id", "band"), "id")).over(bucket)["id"]
    return members.select("band", "key", "id", leader.alias("leader"), F.count("*").over(bucket).alias("size")).filter("size > 1").drop("size")


def _edges(members: DataFrame, words: DataFrame) -> DataFrame:
    """Verified pairs of the buckets (band, key, id, leader); see the module's text."""
    every, found, tried = members.select("band", "key", "id"), None, None
    for _ in range(ROUNDS):
        led = members.filter("id != leader").withColumns({"a": F.greatest("id", "leader"), "b": F.least("id", "leader")})
        seen = written(_aligned(led.select("a", "b").distinct(), words), "aligned")
        good, far = seen.filter("near").select("a", "b", "similarity"), seen.filter("NOT near").select("a", "b")
        found = good if found is None else found.union(good)
        tried = far if tried is None else tried.union(far)
        failed = written(led.join(far, ["a", "b"], "left_semi").select("band", "key", "id"), "failed")
        if failed.isEmpty():
            return found
        members = written(_led(failed), "members")
        if members.isEmpty():
            break
    rest = _apart(every, found, words).join(tried, ["a", "b"], "left_anti")
    last = written(_aligned(rest, words), "aligned")
    return found.union(last.filter("near").select("a", "b", "similarity"))


def _grouped(docs: DataFrame) -> DataFrame:
    """Of every row that has a near or exact copy: doc_id, text_hash, group_id and keep."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("text")).filter("id IS NOT NULL AND text != ''")
    rows = written(_sketches(source).withColumn("row", F.monotonically_increasing_id()), "sketches")
    named = written(rows.select("row", "id", "text_hash", "whole"), "named")
    firsts = written(named.groupBy("whole").agg(F.min("row").alias("node")), "firsts")
    nodes = rows.select("row", "bands").join(small(firsts.select(F.col("node").alias("row"))), "row", "left_semi")
    members = written(_led(nodes.select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "key"))), "members")
    wanted = members.select(F.col("id").alias("row")).distinct()
    words = written(rows.select("row", "words").join(small(written(wanted, "wanted")), "row", "left_semi").withColumnRenamed("row", "id"), "words")
    drop(rows)
    roots = components(_edges(members, words))
    drop(words)
    drop(members)
    every = named.join(firsts, "whole").join(roots, "node", "left")
    every = written(every.select("row", "id", "text_hash", "whole", F.coalesce("root", "node").alias("group")), "grouped")
    drop(named)
    drop(firsts)
    heads = every.groupBy("group").agg(F.count("*").alias("size"), F.min(F.struct("id", "whole", "row")).alias("head")).filter("size > 1")
    return every.join(heads, "group").select(F.col("id").alias("doc_id"), "text_hash", F.col("head.id").alias("group_id"), (F.col("row") == F.col("head.row")).alias("keep"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the group's smallest id) and keep, for every row that has a near or exact copy."""
    return _grouped(docs).select("doc_id", "group_id", "keep")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group; rows without an id or words stay.

    Of rows that repeat both id and text, and differ in other columns, the one whose JSON comes first stays.
    """
    cases = written(_grouped(docs), "cases").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    cases = written(cases, "cases")
    gone = small(cases.filter("NOT keep OR n > 1").select("__id", "__text"))
    same = lambda side: (docs["doc_id"].cast("bigint") == side["__id"]) & (F.xxhash64(docs["text"].cast("string")) == side["__text"])
    left = docs.join(gone, same(gone), "left_anti")
    again = small(cases.filter("keep AND n > 1").select("__id", "__text"))
    if again.isEmpty():
        return left
    once = docs.join(again, same(again)).select(again["__id"], again["__text"], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    once = once.groupBy("__id", "__text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.unionByName(once.select("row.*"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spread(table(spark, sf_dir, "documents")))
