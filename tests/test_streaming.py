import random

import numpy as np
import pyarrow as pa
import pytest

from loomtext.config import MinHash, SimHash
from loomtext.kernels import sketch
from loomtext.streaming import chunked as c

TEXTS = {1: "naïve café – ünïcödé text of some length " * 5, 2: "plain words only", 3: "漢字かな交じり文 " * 9, 4: "?!"}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_any_cut_gives_the_whole(spark, size):
    docs = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    pieces = c.cut(docs, size)
    got = {r.id: r for r in c.minhash_of_chunks(pieces.unionByName(pieces.limit(5))).collect()}
    want = sketch.minhash(list(TEXTS.values()), MinHash())[0].view(np.int64)
    for i, w in zip(TEXTS, want):
        assert got[i].error == ("empty document" if i == 4 else None) and (i == 4 or got[i].sig.hashes == w.tolist())
    simple = {r.id: r.sig for r in c.simhash_of_chunks(pieces).collect()}
    assert simple[1] == int(sketch.simhash([TEXTS[1]], SimHash())[0].view(np.int64)[0]) and simple[4] is None


def test_chunk_errors(spark):
    rows = [(1, 0, b"ok \xe2\x82"), (1, 1, b"\xac"), (2, 0, b"\xff"), (3, 0, b"a\xc3"), (4, 0, None), (5, 0, b"x" * 30), (None, 0, b"x")]
    got = {r.id: r.error for r in c.minhash_of_chunks(spark.createDataFrame(rows, "id long, seq int, chunk binary"), max_bytes=20).collect()}
    assert got == {1: None, 2: c.INVALID, 3: c.TRAILING, 4: c.EMPTY, 5: c.too_long(20)}
    assert c.decoded("é".encode()[:1]) == (None, c.TRAILING) and c.decoded(b"") == ("", None)


@pytest.mark.parametrize("config", [MinHash(32), SimHash()])
def test_stream(spark, tmp_path, config):
    """Chunks out of order and over several batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []
    for i, t in TEXTS.items():
        b = t.encode()
        cuts = [b[j : j + 11] for j in range(0, len(b), 11)]
        rows += [(i, s, bytearray(x), s == len(cuts) - 1) for s, x in enumerate(cuts)]
    rows += [(8, 0, bytearray(b"\xff"), True), (9, 0, bytearray(b"never ended"), False), (10, 0, bytearray(b"x" * 900), True), (None, 0, bytearray(b"x"), True)]
    random.Random(4).shuffle(rows)
    kind = "id long, seq int, chunk binary, last boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = c.sketch_stream(stream, config, max_bytes=800).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(200)
    assert q.exception() is None
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3, 4, 8, 10}
    assert [got[i].error for i in (4, 8, 10)] == [c.EMPTY, c.INVALID, c.too_long(800)]
    for i in (1, 2, 3):
        if isinstance(config, SimHash):
            assert got[i].sig == int(sketch.simhash([TEXTS[i]], config)[0].view(np.int64)[0])
        else:
            assert got[i].sig == sketch.minhash([TEXTS[i]], config)[0].view(np.int64)[0].tolist()


def test_chunks_take_one_trip_to_python(spark):
    """Decoding and sketching side by side would hold two workers, each with its own copy of the texts."""
    pieces = c.cut(spark.createDataFrame(list(TEXTS.items()), "id long, text string"), 5)
    for sketched in (c.minhash_of_chunks(pieces), c.simhash_of_chunks(pieces)):
        assert sketched._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_batches_in_pieces(spark, monkeypatch):
    """A batch is never Python objects as a whole, and its pieces give what the whole does."""
    from loomtext.functions import text

    monkeypatch.setattr(text, "PIECE", 100)
    values = pa.array([None, "", *(f"text {i}" for i in range(200)), None])
    parts = list(text.pieces(values))
    assert max(map(len, parts)) < 20 and [x for p in parts for x in p] == values.to_pylist()
    assert text.mapped(values, len, pa.int32()).to_pylist() == [None if x is None else len(x) for x in values.to_pylist()]
    assert list(text.pieces(values[:0])) == [[]] and len(text.mapped(values[:0], len, pa.int32())) == 0
