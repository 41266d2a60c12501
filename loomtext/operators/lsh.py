"""The banded index over MinHash signatures: two tables, and joins of them.

``signatures`` (id, sig) and ``buckets`` (band, key, id) stand for the index. A probe meets the ids with which it shares the key of a
band; keys are hashes of the band's slots, so a candidate may rarely be a coincidence, which verification by
estimated Jaccard removes. Joins are equi-joins on (band, key), left to the optimiser and to adaptive skew handling.

Defined results: rows with a null id or a null signature are not in the index. A signature of another width than the
partition's is refused by an error at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.errors import ConfigError
from loomtext.functions.sketches import jaccard

_F = np.float32


def collision(t: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Chance that documents of Jaccard t share a band, in single precision."""
    inner = np.clip(_F(1) - np.power(np.asarray(t, _F), _F(rows), dtype=_F), _F(0), _F(1))
    return _F(1) - np.power(inner, _F(bands), dtype=_F)


def _area(low: float, high: float, f) -> np.float32:
    """By 200 trapezia."""
    if high <= low:
        return _F(0)
    step = (_F(high) - _F(low)) / _F(200)
    y = f(_F(low) + np.arange(201, dtype=_F) * step)
    return (y[1:-1].sum(dtype=_F) + _F(0.5) * (y[0] + y[-1])) * step


@dataclass(frozen=True)
class Partition:
    bands: int
    rows: int

    def __post_init__(self) -> None:
        if self.bands < 1 or self.rows < 1:
            raise ConfigError("bands and rows are at least 1")

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    def checked(self, slots: int) -> Partition:
        if self.slots != slots:
            raise ConfigError(f"{self.bands} bands of {self.rows} rows do not make {slots} slots")
        return self

    @staticmethod
    def for_threshold(threshold: float, slots: int) -> Partition:
        """The factor pair with the least area of false matches under and missed ones above the threshold."""
        if not 0 < threshold < 1:
            raise ConfigError(f"the threshold lies in (0, 1), not {threshold}")
        if slots < 1:
            raise ConfigError("a signature has at least one slot")
        pairs = [(b, slots // b) for b in range(1, slots + 1) if slots % b == 0]
        cost = [_area(0, threshold, lambda t: collision(t, b, r)) + _area(threshold, 1, lambda t: _F(1) - collision(t, b, r)) for b, r in pairs]
        return Partition(*pairs[int(np.argmin(cost))])


def band_keys(sig: Column, p: Partition) -> Column:
    """One key for each band."""
    h = sig["hashes"]
    right = F.assert_true(F.size(h) == p.slots, F.lit(f"signatures must have {p.slots} slots")).isNull()
    return F.when(right, F.array(*[F.xxhash64(F.slice(h, b * p.rows + 1, p.rows)) for b in range(p.bands)]))


def buckets(signatures: DataFrame, p: Partition) -> DataFrame:
    """band, key, id: the index's postings."""
    live = signatures.filter("id IS NOT NULL AND sig IS NOT NULL")
    return live.select("id", F.posexplode(band_keys(F.col("sig"), p)).alias("band", "key")).select("band", "key", "id")


def insert(signatures: DataFrame, new: DataFrame) -> DataFrame:
    """Index contents with ``new`` rows in; a repeated id takes the new signature (the largest, of several new ones)."""
    both = signatures.select("id", "sig", F.lit(0).alias("age")).unionByName(new.select("id", "sig", F.lit(1).alias("age")))
    last = both.filter("id IS NOT NULL AND sig IS NOT NULL").groupBy("id").agg(F.max(F.struct("age", "sig")).alias("s"))
    return last.select("id", F.col("s")["sig"].alias("sig"))


def bulk_insert(signatures: DataFrame, new: DataFrame) -> DataFrame:
    """For ids that are fresh and unique, without a shuffle of signatures; others fail the job."""
    fresh = new.filter("id IS NOT NULL AND sig IS NOT NULL").select("id", "sig")
    ids = signatures.select("id").unionByName(fresh.select("id"))
    twice = ids.groupBy("id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ConfigError("bulk insertion takes ids that are new and come once")
    return signatures.select("id", "sig").unionByName(fresh)


def remove(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` (signatures or buckets) without these ids."""
    return table.join(ids.select("id").distinct(), "id", "left_anti").select(table.columns)


def query(probes: DataFrame, index: DataFrame, p: Partition) -> DataFrame:
    """probe, id: candidates of every probe (id, sig) in the index's buckets, each once."""
    mine = buckets(probes, p).withColumnRenamed("id", "probe")
    return mine.join(index, ["band", "key"]).select("probe", "id").distinct()


def verify(candidates: DataFrame, probes: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """probe, id, jaccard of the candidates at or above the threshold, compared in single precision."""
    t = F.lit(float(min(1.0, max(0.0, threshold)))).cast("float")
    both = candidates.join(probes.select(F.col("id").alias("probe"), F.col("sig").alias("__a")), "probe").join(signatures.select("id", F.col("sig").alias("__b")), "id")
    scored = both.select("probe", "id", jaccard("__a", "__b").alias("jaccard"))
    return scored.filter(F.col("jaccard") >= t)


def query_verified(probes: DataFrame, signatures: DataFrame, p: Partition, threshold: float) -> DataFrame:
    return verify(query(probes, buckets(signatures, p), p), probes, signatures, threshold)


def similar_pairs(signatures: DataFrame, p: Partition, threshold: float) -> DataFrame:
    """a < b and jaccard of all index members that collide and reach the threshold; ids must be unique.

    Equal signatures are folded into their smallest id before the join, so a text copied n times adds n rows, not n * n,
    to what is shuffled and verified; the pairs of copies are spelt out at the end.
    """
    t = F.lit(float(min(1.0, max(0.0, threshold)))).cast("float")
    live = signatures.filter("id IS NOT NULL AND sig IS NOT NULL").select("id", "sig", F.xxhash64("sig").alias("h1"), F.hash("sig").alias("h2"))
    same = W.partitionBy("h1", "h2", "sig")
    folded = live.withColumn("rep", F.min("id").over(same)).select("id", "sig", "rep")
    reps = folded.filter("id = rep").select("id", "sig")
    b = buckets(reps, p)
    pairs = b.select("band", "key", F.col("id").alias("x")).join(b.select("band", "key", F.col("id").alias("y")), ["band", "key"]).filter("x < y").select("x", "y").distinct()
    scored = pairs.join(reps.select(F.col("id").alias("x"), F.col("sig").alias("__a")), "x").join(reps.select(F.col("id").alias("y"), F.col("sig").alias("__b")), "y")
    scored = scored.select("x", "y", jaccard("__a", "__b").alias("jaccard")).filter(F.col("jaccard") >= t)
    members = folded.select("id", "rep")
    near = scored.join(members.select(F.col("rep").alias("x"), F.col("id").alias("i")), "x").join(members.select(F.col("rep").alias("y"), F.col("id").alias("j")), "y")
    near = near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")
    equal = members.alias("l").join(members.alias("r"), "rep").filter("l.id < r.id")
    return near.unionByName(equal.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.lit(1.0).cast("float").alias("jaccard")))
