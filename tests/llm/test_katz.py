import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import katz as z


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1)), st.lists(st.integers(0, 2**64 - 1)), st.lists(st.floats(allow_nan=False)))
def test_pack_round_trip(a, b, c):
    got = z.unpack(z.pack(np.array(a, np.uint64), np.array(b, np.uint64), np.array(c, float)))
    assert got[0].tolist() == a and got[1].tolist() == b and got[2].tolist() == c


class Plain:
    """The model spelt out over dictionaries."""

    def __init__(self, texts, order, least=z.LEAST, k=z.K):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]
        self.followed = [Counter() for _ in range(order + 1)]
        for ws in texts:
            for n in range(1, order + 1):
                for i in range(len(ws) - n + 1):
                    self.c[n][tuple(ws[i : i + n])] += 1
                    self.followed[n][tuple(ws[i : i + n])] += i + n < len(ws)
        self.times = [None] + [[sum(v == r for v in self.c[n].values()) for r in range(1, k + 2)] for n in range(1, order + 1)]
        self.d = [None] + [z.discounts(self.times[n], k) for n in range(1, order + 1)]
        self.k = k
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, c in self.c[n].items():
                if n == 1 or c >= least:
                    self.after[n][g[:-1]].append(g[-1])
        n1, n2 = self.times[1][:2]
        self.unseen = max(1.0, n1 * (n1 - 1) / 2 / (n2 + 1))
        self.memo = {}

    def part(self, h):
        """The distribution after h: by the words of the model, and alpha."""
        if h in self.memo:
            return self.memo[h]
        n = len(h) + 1
        words = self.after[n][h]
        total = self.followed[n - 1][h] if h else sum(self.c[1].values())
        kept = {w: (1 if (c := self.c[n][(*h, w)]) > self.k else self.d[n][c - 1]) * c for w in words}
        if sum(kept.values()) > total * (1 - 1e-12):
            kept, total = {w: self.c[n][(*h, w)] for w in words}, total + 1
        p = {w: v / total for w, v in kept.items()}
        left = 1 - sum(p.values())
        self.memo[h] = p, left / self.unseen if n == 1 else left / (1 - sum(self.p(w, h[1:]) for w in words)) if words else 1.0
        return self.memo[h]

    def p(self, w, h):
        if len(h) > 0 and not self.after[len(h) + 1][h]:
            return self.p(w, h[1:])
        p, alpha = self.part(h)
        return p[w] if w in p else alpha * (self.p(w, h[1:]) if h else 1)

    def score(self, ws):
        return sum(math.log(self.p(w, tuple(ws[max(0, i - self.order + 1) : i]))) for i, w in enumerate(ws))


def words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


@pytest.mark.parametrize("order,least", [(1, 2), (2, 1), (3, 2), (4, 1)])
def test_against_brute_force(spark, order, least, monkeypatch):
    monkeypatch.setattr(z, "FLUSH", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = docs.collect()
    plain = Plain([words(r.text) for r in rows], order, least)
    model = z.fit(docs, order, least, bucket_words=10_000)
    got = {r.doc_id: r for r in z.score(docs, model, bucket_words=7000).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].n_words == len(words(r.text)) and (got[r.doc_id].logprob or 0) == pytest.approx(plain.score(words(r.text)), rel=1e-9)
    vocabulary = {g[0] for g in plain.c[1]}
    for h in list(plain.after[order])[:20]:  # each distribution sums to 1
        assert sum(plain.p(w, h) for w in vocabulary) + plain.unseen * plain.p("unheard of", h) == pytest.approx(1)
    other = spark.createDataFrame([(1, "unheard the of"), (2, "the of " + rows[0].text + " unheard"), (3, "")], "doc_id long, text string")
    for r, t in zip(sorted(z.score(other, model).collect()), sorted(other.collect())):
        assert (r.logprob or 0) == pytest.approx(plain.score(words(t.text)), rel=1e-9)


def test_stored_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = z.read_model(spark, z.fit(docs, 2).path)
    plain = Plain([words(r.text) for r in docs.collect()], 2)
    assert (model.order, model.words) == (2, sum(plain.c[1].values())) and model.discount[2].tolist() == [0.0, *plain.d[2], 1.0]
    rows = model.ngrams.collect()
    singles = [r for r in rows if r.ord == 1]
    assert len(singles) == len(plain.c[1]) and sorted(r["count"] for r in singles) == sorted(plain.c[1].values())
    assert sorted(r["count"] for r in rows if r.ord == 2) == sorted(c for c in plain.c[2].values() if c >= z.LEAST)
    want = sorted(plain.part(h)[1] if h in plain.after[2] else 1.0 for h in plain.c[1])
    assert sorted(r.backoff for r in singles) == pytest.approx(want)


def test_invented_words_score_below_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(3)
    junk = [(10**6 + i, " ".join("".join(rng.choice(list("bcdfghklmnprstvz"), 9)) for _ in range(80))) for i in range(40)]
    every = docs.union(spark.createDataFrame(junk, "doc_id long, text string"))
    got = [(r.doc_id >= 10**6, r.mean_logprob) for r in z.score(every, z.fit(every)).collect() if r.n_words > 20]
    best = max(p for is_junk, p in got if is_junk)
    assert np.mean([p > best for is_junk, p in got if not is_junk]) > 0.95


def test_hard_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "?!", "x"), (None, "one two one two", "x"), (4, "one two three", "y"), (4, "one two three", "y"), (5, "one", "z"), (6, "two two " * 20_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = [tuple(r) for r in z.score(docs, z.fit(docs)).collect()]
    assert len(got) == 8 and sum(r[1] == 0 and r[2] is None and r[3] is None for r in got) == 3
    plain = Plain([words(t) for _, t, _ in rows], 3)
    for i, t, _ in rows:
        if words(t):
            assert any(r[0] == i and r[1] == len(words(t)) and r[2] == pytest.approx(plain.score(words(t))) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert z.score(empty, z.fit(empty)).count() == 0 and z.score(empty, z.fit(docs)).count() == 0
    none = z.score(docs, z.fit(empty))
    assert none.count() == 8 and none.filter("logprob < 0").count() == 5
    with pytest.raises(ValueError):
        z.fit(docs, 0)


def test_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    assert {tuple(r) for r in z.op1_katz(spark, "/root/testdata/sf0.001").collect()} == set(con.sql(z.SQL).fetchall())
