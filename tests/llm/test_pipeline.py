import math

import pyarrow as pa
import pytest

import corpus_pipeline as c
from loomtext.llm import language_id, mixing, order_minhash, packing
from loomtext.llm._text import encoder, flat, tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def stage(name):
    return dict(c.STAGES)[name]


def test_stages(spark, docs):
    assert [n for n, _ in c.STAGES] == ["language identification", "near duplicates", "source mixing", "packing"]
    assert c.ORACLE_SQL is None


def test_language_stage_keeps_what_the_model_accepts(spark, docs):
    model = language_id.fit(docs)
    rows = docs.collect()
    raw, off = flat(pa.array([r.text.lower() for r in rows]))
    want = sorted(r.doc_id for r, ok in zip(rows, language_id.predict(model, raw, off)[3]) if ok)
    got = stage("language identification")(spark, docs, None)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) > 0.9 * sum(len(r.text.split()) > 5 for r in rows)


def test_near_duplicate_stage_against_all_pairs(spark, docs):
    rows = docs.collect()
    numbered = {r.doc_id: [w for w in "".join(ch if ch.isascii() and ch.isalnum() or ord(ch) > 127 else " " for ch in r.text.lower()).split(" ") if w] for r in rows}
    parent = {i: i for i in numbered}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in numbered.items():
        for j, b in numbered.items():
            most = order_minhash.allowed(max(len(a), len(b)))
            if i < j and a and b and abs(len(a) - len(b)) <= most and order_minhash.banded_distance(a, b, most) <= most:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i for i in numbered if root(i) == i}
    got = stage("near duplicates")(spark, docs, None)
    kept = {r.doc_id for r in got.collect()}
    assert got.columns == docs.columns and want <= kept
    assert len(set(numbered) - kept) >= 0.9 * len(set(numbered) - want)


def test_mixing_stage_and_packing_stage(spark, docs):
    mixed = stage("source mixing")(spark, docs, None)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.rates(docs).collect()}
    rows = mixed.collect()
    assert {i: n for i, n in copies.items() if n} == {i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}}
    encode = encoder(tokenizer_path()).encode_ordinary
    size = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    share, total = {}, sum(size.values())
    for r in docs.collect():
        share[r.source] = share.get(r.source, 0) + size[r.doc_id] / total
    goal = {s: v**mixing.TEMPER for s, v in share.items()}
    rate = {r.source: 0.0 for r in docs.collect()}
    for r in mixing.rates(docs).collect():
        rate[r.source] += r.rate * r.n_tokens / total
    assert all(math.isclose(rate[s], goal[s] / sum(goal.values()), rel_tol=1e-4) for s in goal)
    packed = stage("packing")(spark, mixed, None).collect()
    assert sum(r.n_tokens for r in packed) == sum(size[r.doc_id] + 1 for r in rows if r.text)
    assert max(r.start + r.n_tokens for r in packed) <= packing.WINDOW


def test_run_is_its_stages(spark):
    got = c.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, f in c.STAGES:
        docs = f(spark, docs, "/root/testdata/sf0.001")
    key = lambda rows: sorted((r.doc_id, r.piece, r.n_tokens) for r in rows)
    assert key(got) == key(docs.collect())


def test_hard_rows(spark):
    long = "alles ist gut und bleibt so " * 8_000
    rows = [(1, None, "en", "a", 0), (None, "some words in a row that say little", None, None, 0), (2, "", "en", "a", 0), (3, long, "de", "b", 7), (3, long, "de", "b", 7)]
    rows += [(i, f"plain english text number {i} and some more words of it {i * i}", "en", "a", 0) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rate int")
    for made in (docs, docs.limit(0)):
        for name, f in c.STAGES[:-1]:
            made = spark.createDataFrame(f(spark, made, None).collect(), docs.schema)
            assert made.columns == docs.columns
        c.STAGES[-1][1](spark, made, None).collect()
