import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.config import MURMUR3, XXH3, Canonical, MinHash, SimHash, Tokens
from loomtext.errors import ConfigError
from loomtext.functions import sketches as S
from loomtext.functions import text as X
from loomtext.functions import vectors as V
from loomtext.functions.registration import register
from loomtext.kernels import sketch
from loomtext.operators import corpus, lsh
from loomtext.operators import sketches as K

FOX = {
    1: "The quick brown fox jumps over the lazy dog near the river bank",
    2: "The quick brown fox jumps over the lazy dog near the river banks",
    3: "the QUICK brown fox jumps over the lazy dog near the river bank",
    4: "A quick brown fox jumped over a lazy dog near some river bank",
    5: "Completely unrelated sentence about quarterly financial statements and audits",
    6: "Deep sea creatures make light in ways that science does not yet follow",
}
SMALL = MinHash(64, Tokens(shingle=(2,)))


@pytest.fixture(scope="module")
def fox(spark):
    return spark.createDataFrame(list(FOX.items()), "id long, text string")


def plain_jaccard(a, b):
    return np.float32((a == b).mean())


def test_canonical_tokens_and_policies(spark):
    df = spark.createDataFrame([(None,), ("",), ("ÀB c",), ("Plain",)], "text string")
    got = df.select(X.canonicalize("text").alias("c"), X.tokens("text").alias("t"), X.token_count("text").alias("n"), X.chunks("text").alias("k")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None), ("", [], 0, []), ("àb c", ["ÀB", "c"], 2, ["ÀB c"]), ("plain", ["Plain"], 1, ["Plain"])]
    m = df.select(S.minhash("text", SMALL).alias("m")).collect()
    assert [(r.m.sig is None, r.m.error) for r in m] == [(True, None), (True, "empty document"), (False, None), (False, None)]
    assert [r[0] is None for r in df.select(S.simhash("text", on_error="null")).collect()] == [True, True, False, False]
    assert df.filter("text != ''").select(S.simhash("text", on_error="raise").alias("s")).filter("s IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="empty document"):
        df.select(S.simhash("text", on_error="raise")).collect()
    with pytest.raises(ConfigError):
        S.minhash("text", SMALL, on_error="whatever")


def test_shingles_and_fixed_chunks_natively(spark):
    from loomtext.kernels import chunk, words

    lists = [[f"w{i}" for i in range(n)] for n in range(0, 30)]
    df = spark.createDataFrame([(w,) for w in lists] + [(None,)], "w array<string>")
    for k in (0, 1, 3, 7):
        got = [r[0] for r in df.select(X.shingles("w", k)).collect()]
        assert got == [words.shingles(w, k) for w in lists] + [None]
    for most, overlap in ((4, 2), (10, 0), (13, 12), (1, 9), (0, 0)):
        got = [r[0] for r in df.select(X.fixed_chunks("w", most, overlap)).collect()]
        assert got == [chunk.chunks(" ".join(w), most, overlap, "fixed") for w in lists] + [None]


def test_sketch_columns_are_the_kernels(spark, fox):
    texts = list(FOX.values())
    for family in (XXH3, MURMUR3):
        c = MinHash(64, Tokens(shingle=(2,)), family=family)
        want = sketch.minhash(texts, c)[0].view(np.int64).tolist()
        assert [r.m.hashes for r in fox.orderBy("id").select(S.minhash("text", c, "null").alias("m")).collect()] == want
        want = sketch.simhash(texts, SimHash(family=family))[0].view(np.int64).tolist()
        assert [r.s for r in fox.orderBy("id").select(S.simhash("text", SimHash(family=family), on_error="null").alias("s")).collect()] == want


def test_comparisons(spark, fox):
    s = fox.select("id", S.minhash("text", SMALL, "null").alias("m"), S.simhash("text", on_error="null").alias("s"))
    pairs = s.alias("a").crossJoin(s.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), S.jaccard("a.m", "b.m").alias("x"), S.hamming("a.s", "b.s").alias("h"), S.cosine_estimate("a.s", "b.s").alias("c")).collect()
    m, p = sketch.minhash(list(FOX.values()), SMALL)[0], sketch.simhash(list(FOX.values()), SimHash())[0]
    for r in pairs:
        assert r.x == plain_jaccard(m[r.i - 1], m[r.j - 1])
        assert r.h == (int(p[r.i - 1]) ^ int(p[r.j - 1])).bit_count() and r.c == pytest.approx(np.cos(r.h / 64 * np.pi), abs=1e-6)
    by = {(r.i, r.j): r.x for r in pairs}
    assert by[1, 3] == 1 and by[1, 2] > 0.5 > by[1, 5]


def test_serial_forms(spark, fox):
    s = fox.select("id", S.minhash("text", SMALL, "null").alias("m"), S.simhash("text", on_error="null").alias("p"))
    got = s.select("m", "p", S.minhash_bytes("m").alias("b"), S.minhash_tuple("m").alias("t"), S.minhash_json("m").alias("j"), S.simhash_json("p").alias("pj"), S.simhash_bytes("p").alias("pb"), S.show_minhash("m").alias("show"))
    for r in got.collect():
        slots = np.array(r.m.hashes, np.int64).view(np.uint64)
        assert bytes(r.b) == b"\1\0" + bytes(6) + slots.astype("<u8").tobytes() and bytes(r.t) == b"\1\0" + slots.astype("<u8").tobytes()
        assert json.loads(r.j) == {"schema": 1, "hashes": slots.tolist()} and int(r.pj) == r.p % 2**64
        assert bytes(r.pb) == int(r.p % 2**64).to_bytes(8, "little") and r.show.endswith("..+60 more)") and f"{slots[0]:016x}" in r.show
    back = got.select("m", "p", S.minhash_from_bytes("b", 64).alias("b"), S.minhash_from_bytes("t", 64, "null", padded=False).alias("t"), S.minhash_from_json("j", 64).alias("j"), S.simhash_from_json("pj").alias("pj"))
    for r in back.collect():
        assert r.b.sig == r.m == r.j.sig == r.t and r.b.error is None and r.j.error is None and r.pj == r.p
    bad = ['{"schema":1,"hashes":[1,2]}', '{"hashes":[1,2,3]}', '{"schema":1,"hashes":[1,2,3],"x":1}', '{"schema":1,"hashes":[1,2,-3]}', '{"schema":2,"hashes":[1,2,3]}', "no json", '{"schema":1,"hashes":[1,2,18446744073709551616]}']
    rows = spark.createDataFrame([(b,) for b in bad] + [('{"schema":1,"hashes":[1,2,18446744073709551615]}',), (None,)], "j string").select(S.minhash_from_json("j", 3).alias("s")).collect()
    assert all(r.s.sig is None and r.s.error for r in rows[:-2])
    assert rows[-2].s.sig.hashes == [1, 2, -1] and rows[-1].s.sig is None and rows[-1].s.error is None
    wrong = spark.createDataFrame([(bytearray(5),), (bytearray(32),)], "b binary").select(S.minhash_from_bytes("b", 3).alias("s")).collect()
    assert "expected 32 bytes" in wrong[0].s.error and "schema mismatch" in wrong[1].s.error
    assert [r[0] for r in spark.sql("SELECT explode(array('18446744073709551615', '18446744073709551616', 'x', '5')) v").select(S.simhash_from_json("v")).collect()] == [-1, None, None, 5]


def test_tlsh_columns(spark):
    from tests.test_kernels import ALPHA, BETA

    df = spark.createDataFrame([(ALPHA,), (ALPHA.upper(),), (BETA,), ("short",), (None,)], "t string")
    got = [r.d for r in df.select(S.tlsh_digest("t").alias("d")).collect()]
    assert got[0].digest == got[1].digest != got[2].digest and got[3].error and got[4].error is None
    raw = [r.d.digest for r in df.select(S.tlsh_digest_bytes(F.encode("t", "UTF-8")).alias("d")).collect()]
    assert raw[0] != raw[1]
    d = spark.createDataFrame([(got[0].digest, got[2].digest), (got[0].digest, "T1"), (None, "x")], "a string, b string").select(S.tlsh_distance("a", "b").alias("d"), S.is_tlsh("a").alias("v")).collect()
    assert d[0].d.distance > 0 and d[1].d.error and d[2].d.distance is None and d[0].v


def test_metadata(spark, fox):
    df = fox.limit(1).select(S.minhash("text", on_error="null").alias("m"), S.simhash("text", on_error="null").alias("s"))
    emb = F.struct(F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("vector"), F.lit("mod").alias("model_id"))
    kinds = {"m": S.fingerprint(minhash=F.col("m")), "s": S.fingerprint(simhash=F.col("s")), "t": S.fingerprint(tlsh=F.lit("T1" + "0" * 70)), "e": S.fingerprint(embedding=emb)}
    r = df.select(*[S.metadata(c).alias(k) for k, c in kinds.items()], *[S.name(c).alias(k + "n") for k, c in kinds.items()]).first()
    assert [tuple(r[k]) for k in kinds] == [("minhash-h128", 0, None, 1, 1032), ("simhash-b64", 0, None, 1, 8), ("tlsh", 0, None, 1, 72), ("embedding", 0, "mod", 1, 8)]
    assert [r[k + "n"] for k in kinds] == ["minhash-h128-v1", "simhash-b64-v1", "tlsh-v1", "embedding/mod-v1"]
    a = S.metadata(kinds["m"], MinHash())
    b = S.metadata(kinds["m"], MinHash(family=MURMUR3))
    assert list(df.select(S.comparable(a, a), S.comparable(a, b), S.comparable(S.with_config_hash(a, 0), b), S.comparable(S.metadata(kinds["s"]), b)).first()) == [True, False, True, False]
    with pytest.raises(ConfigError):
        S.fingerprint(F.col("m"), F.col("s"))


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([3.0, 4.0],), ([],), ([nan],), ([inf, 1.0],), (None,), ([0.0, 0.0],)], "v array<double>")
    got = [r.e for r in df.select(V.embedding("v", "m").alias("e")).collect()]
    assert [e.embedding is not None for e in got] == [True, False, False, False, False, True]
    assert got[1].error == "empty embedding" and got[4].error is None
    rows = [([3.0, 4.0], "a", [4.0, 3.0], "a"), ([1.0], "a", [1.0, 2.0], "b"), ([1.0], None, [1.0, 2.0], "b"), ([0.0, 0.0], None, [1.0, 2.0], None)]
    pairs = spark.createDataFrame(rows, "x array<float>, p string, y array<float>, q string")
    x, y = F.struct(F.col("x").alias("vector"), F.col("p").alias("model_id")), F.struct(F.col("y").alias("vector"), F.col("q").alias("model_id"))
    got = pairs.select(V.cosine(x, y).alias("c"), V.dot(x, y).alias("d"), V.l2_norm(x).alias("n"), V.normalize(x).alias("u"), V.embedding_json(x).alias("j")).collect()
    assert got[0].c.value == pytest.approx(0.96) and got[0].d.value == 24 and got[0].n == 5 and got[0].u.vector == pytest.approx([0.6, 0.8])
    assert [r.c.error for r in got] == [None, "model mismatch: a vs b", "dimension mismatch: 1 vs 2", "zero vector"]
    assert got[3].u.vector == [0, 0] and got[3].d.value == 0 and json.loads(got[2].j) == {"vector": [1.0], "model_id": None}
    assert pairs.select(V.embedding_from_json(V.embedding_json(x)).alias("b"), x.alias("x")).filter("b != x").count() == 0
    pooled = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1, 0])], "h array<float>, m array<bigint>").select(V.pool("h", 2, "m", "mean_no_norm"), V.pool("h", 2, None, "max")).first()
    assert pooled[0] == [1, 2] and pooled[1] == pytest.approx([0.6, 0.8])


# the index


def test_partitions():
    for (t, h), want in {(0.7, 128): (16, 8), (0.5, 64): (16, 4), (0.9, 256): (8, 32)}.items():
        p = lsh.Partition.for_threshold(t, h)
        assert (p.bands, p.rows) == want and p.slots == h
    for bad in (lambda: lsh.Partition(0, 4), lambda: lsh.Partition(2, 4).checked(9), lambda: lsh.Partition.for_threshold(1, 128), lambda: lsh.Partition.for_threshold(0.5, 0)):
        with pytest.raises(ConfigError):
            bad()
    assert lsh.collision(0.0, 4, 4) == 0 and lsh.collision(1.0, 4, 4) == 1


def test_index_life(spark, fox):
    p = lsh.Partition(32, 2)
    sigs = fox.select("id", S.minhash("text", SMALL, "null").alias("sig")).cache()
    index = lsh.buckets(sigs, p)
    assert index.count() == 6 * 32
    found = {tuple(r) for r in lsh.query(sigs, index, p).collect()}
    m = sketch.minhash(list(FOX.values()), SMALL)[0].reshape(6, 32, 2)
    want = {(i + 1, j + 1) for i, j in itertools.product(range(6), repeat=2) if (m[i] == m[j]).all(axis=1).any()}
    assert found == want and {(i, i) for i in FOX} <= found
    near = {tuple(r) for r in lsh.query_verified(sigs, sigs, p, 0.5).select("probe", "id").collect()}
    assert near == {(i, j) for i, j in found if (m[i - 1] == m[j - 1]).mean() >= 0.5} and (1, 2) in near
    pairs = {(r.a, r.b): r.jaccard for r in lsh.similar_pairs(sigs, p, 0.5).collect()}
    assert set(pairs) == {(i, j) for i, j in near if i < j} and pairs[1, 3] == 1
    gone = lsh.remove(index, spark.createDataFrame([(2,), (99,)], "id long"))
    assert gone.count() == 5 * 32 and {r.id for r in lsh.query(sigs, gone, p).collect()} == set(FOX) - {2}
    new = spark.createDataFrame([(5, FOX[1]), (7, FOX[6])], "id long, text string").select("id", S.minhash("text", SMALL, "null").alias("sig"))
    merged = lsh.insert(sigs, new)
    rows = {r.id: r.sig for r in merged.collect()}
    assert len(rows) == 7 and rows[5] == rows[1] and rows[7] == rows[6]
    assert lsh.bulk_insert(sigs, new.filter("id = 7")).count() == 7
    with pytest.raises(ConfigError):
        lsh.bulk_insert(sigs, new)
    with pytest.raises(Exception, match="64 slots"):
        lsh.buckets(fox.select("id", S.minhash("text", MinHash(32), "null").alias("sig")), p).count()
    empty = sigs.limit(0)
    assert lsh.similar_pairs(empty, p, 0.5).count() == 0 and lsh.query(empty, lsh.buckets(empty, p), p).count() == 0
    nulls = spark.createDataFrame([(None, FOX[1]), (8, None), (9, "")], "id long, text string").select("id", S.minhash("text", SMALL, "null").alias("sig"))
    assert lsh.buckets(nulls, p).count() == 0


def test_copies_are_paired_with_everything_near(spark):
    texts = [FOX[1]] * 5 + [FOX[2]] * 3 + [FOX[5]]
    sigs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", S.minhash("text", SMALL, "null").alias("sig"))
    pairs = {(r.a, r.b) for r in lsh.similar_pairs(sigs, lsh.Partition(32, 2), 0.5).collect()}
    assert pairs == {(i, j) for i in range(8) for j in range(i + 1, 8)}


def test_hamming_pairs(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for v in list(values):
        values += [v ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))), v]
    rows = list(enumerate(values))
    got = {(r.a, r.b, r.distance) for r in K.hamming_pairs(spark.createDataFrame(rows + [(None, 5), (999, None)], "id long, simhash long"), 3).collect()}
    want = {(i, j, d) for i, x in rows for j, y in rows if i < j and (d := ((x ^ y) % 2**64).bit_count()) <= 3}
    assert got == want and len(want) > 150


def test_hamming_pairs_of_alike(spark):
    """Large and small buckets, over batches; each pair once without a shuffle of pairs to tell which came twice."""
    rng = np.random.default_rng(2)
    low = rng.permutation(1 << 11)[:1500]
    values = [int(x) for x in low] + [int(x) << 40 | 7 for x in low[:200]] + [-1, 0, 0]
    rows = list(enumerate(values))
    found = K.hamming_pairs(spark.createDataFrame(rows, "id long, simhash long"), 3)
    got = sorted((r.a, r.b) for r in found.collect())
    v = np.array(values, np.int64)
    want = [(i, int(j)) for i in range(len(v)) for j in i + 1 + np.flatnonzero(np.bitwise_count((v[i + 1 :] ^ v[i]).view(np.uint64)) <= 3)]
    assert got == want and len(want) > 10_000
    assert "Aggregate [x" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_weighted_simhash_and_unions(spark, fox):
    idf = K.idf_table(fox)
    table = {r.token: r.idf for r in idf.collect()}
    want = sketch.simhash(list(FOX.values()), SimHash(weighting="idf"), table)[0].view(np.int64).tolist()
    got = {r.id: r.simhash for r in K.simhash_by_idf(fox, idf).collect()}
    assert [got[i] for i in FOX] == want
    union = K.union_signatures(fox.select(F.lit(1).alias("g"), S.minhash("text", SMALL, "null").alias("s")), "g", "s", 64).first().s.hashes
    assert np.array(union, np.int64).view(np.uint64).tolist() == sketch.minhash(list(FOX.values()), SMALL)[0].min(axis=0).tolist()
    assert {r.token: r.idf for r in K.last_wins(spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 3.0, 0)], "token string, idf double, at int"), "at").collect()} == {"a": 2.0, "b": 3.0}


def test_weighted_simhash_of_many(spark, fox):
    """Ids that repeat or are null, documents longer than a batch, texts without tokens; sums are not shuffled in parts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.3, size) % 90_000) for size in (1, 50, 70_000, 3000, *[300] * 300)]
    idf = K.idf_table(fox).unionByName(spark.createDataFrame([("w1", 0.2), ("w2", -3.5), ("w3", float("inf"))], "token string, idf double"))
    table = {r.token: np.float32(r.idf) for r in idf.collect()}
    rows = [*enumerate(texts), (5000, None), (5001, "?!")]
    found = K.simhash_by_idf(spark.createDataFrame(rows, "id long, text string"), idf)
    assert "partial_sum" not in found._jdf.queryExecution().toString()
    bits = sketch.simhash(texts, SimHash(weighting="idf"), table)[0].view(np.int64).tolist()
    assert {r.id: r.simhash for r in found.collect()} == dict(enumerate(bits))
    again = spark.createDataFrame([("a", texts[1]), ("a", texts[4]), (None, texts[5])], "id string, text string")
    want = sketch.simhash([f"{texts[1]} {texts[4]}", texts[5]], SimHash(weighting="idf"), table)[0].view(np.int64).tolist()
    assert {r.id: r.simhash for r in K.simhash_by_idf(again, idf).collect()} == dict(zip(("a", None), want))


def test_corpus_operations(spark):
    docs = spark.createDataFrame([(1, "Same"), (2, "same"), (3, "other"), (None, "same"), (4, None), (5, "ＳＡＭＥ")], "id long, text string")
    g = corpus.exact_groups(docs)
    assert {tuple(r) for r in g.collect()} == {(1, 1, 3), (2, 1, 3), (5, 1, 3)}
    assert sorted(r.id or 0 for r in corpus.keep_first(docs, g).collect()) == [0, 1, 3, 4]
    items = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    d = spark.createDataFrame([(1, "zero One two three four five"), (2, "one two three"), (3, None)], "id long, text string")
    assert [tuple(r) for r in corpus.contaminated(d, items, Tokens(shingle=(3,))).orderBy("id").collect()] == [(1, 7, 2), (2, 7, 1)]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 8)).astype(np.float32)
    x[11] = x[10]
    x[20] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>").select("id", F.struct("v", F.lit(None).cast("string").alias("model_id")).cast(V.EMBEDDING).alias("e"))
    got = {(r.probe, r["rank"]): r.id for r in corpus.cosine_neighbours(rows, rows, 4, tile=16).collect()}
    norm = np.linalg.norm(x.astype(float), axis=1)
    for i in range(70):
        if i == 20:
            assert (20, 1) not in got
            continue
        score = (x.astype(float) @ x[i].astype(float) / np.maximum(norm * norm[i], 1e-9)).astype(np.float32)
        score[[i, 20]] = -9
        assert [got[i, k] for k in range(1, 5)] == sorted(range(70), key=lambda j: (-score[j], j))[:4]
    assert corpus.cosine_neighbours(rows.limit(0), rows, 2).count() == 0


def test_neighbours_in_rounds(spark, monkeypatch):
    """Rounds of few probes, copies, models and lengths; no vector is shuffled once for each block it meets."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[40:60] = x[3]
    data = [(i, ([float(v) for v in r[: 6 - i % 9 // 8]], [None, "a", "b"][i % 3])) for i, r in enumerate(x)]
    rows = spark.createDataFrame(data, f"id long, e {V.EMBEDDING}")
    monkeypatch.setattr(corpus, "BLOCK", 600)
    found = corpus.cosine_neighbours(rows, rows, 3, tile=16)
    assert "explode" not in found._jdf.queryExecution().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.probe, []).append((r.id, r.score))
    for i, (v, m) in data:
        fits = [(j, w) for j, (w, n) in data if j != i and len(w) == len(v) and (m is None or n is None or m == n)]
        score = {j: np.float32(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))) for j, w in fits}
        want = sorted(score.values(), reverse=True)[:3]
        assert np.allclose([s for _, s in got[i]], want, atol=1e-6) and len({j for j, _ in got[i]}) == 3
        assert all(abs(score[j] - s) < 1e-6 for j, s in got[i])
        if i in range(40, 60):
            same = [j for j in (3, *range(40, 60)) if j in score and len(data[j][1][0]) == len(v) and data[j][1][0] == v]
            assert [j for j, _ in got[i]][: len(same[:3])] == same[:3]


def test_confusables(spark):
    df = spark.createDataFrame([("раураl",), ("paypal",), (None,)], "t string")
    got = [r[0] for r in df.select(X.canonicalize("t", Canonical(confusable=True))).collect()]
    assert got[0] == got[1] is not None and got[2] is None


def test_sql_names(spark):
    names = register(spark)
    assert {"canonicalize", "minhash", "explode_chunks", "simhash_hamming"} <= set(names)
    r = spark.sql("SELECT canonicalize('ABC') c, word_tokens('a b') w, minhash('a b c').hashes h, simhash('') s, text_chunks('a b') k, html_to_text('<p>x') p, markdown_to_text('*x*') m, minhash_jaccard(minhash('x y'), minhash('X y')) j, simhash_hamming(1, 2) d").first()
    assert (r.c, r.w, r.s, r.k, r.p, r.m, r.j, r.d) == ("abc", ["a", "b"], None, ["a b"], "x", "x", 1.0, 2) and len(r.h) == 128
    assert [tuple(x) for x in spark.sql("SELECT * FROM explode_shingles('a b c', 2)").collect()] == [(0, "a b"), (1, "b c")]
    assert spark.sql("SELECT * FROM explode_chunks('a b c', 2, 0, 'fixed')").count() == 3
