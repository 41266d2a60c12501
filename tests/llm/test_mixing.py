import numpy as np
import pytest

from loomtext.llm import mixing as m


def brute(source, lang, t, target, ridge):
    """Gradient steps with backtracking on the dual, over single documents."""
    t = t / t.sum()
    z = np.log(t)
    z = (z - t @ z) / np.sqrt(t @ z**2 - (t @ z) ** 2)
    f = np.c_[np.eye(source.max() + 1)[source], np.eye(lang.max() + 1)[lang], z]
    soft = np.r_[np.zeros(source.max() + 1), np.ones(lang.max() + 2)]
    b = np.r_[target, np.bincount(lang, t), 0.0]
    theta = np.zeros(f.shape[1])
    value = lambda x: t @ np.exp(f @ x) - b @ x + ridge / 2 * soft @ x**2
    for _ in range(200):
        w = t * np.exp(f @ theta)
        g = f.T @ w - b + ridge * soft * theta
        h = (f.T * w) @ f + np.diag(ridge * soft) + 1e-12 * np.eye(len(theta))
        step, move = 1.0, np.linalg.solve(h, -g)
        while value(theta + step * move) > value(theta) + 1e-15:
            step /= 2
            if step < 1e-9:
                break
        theta = theta + step * move
    return np.exp(f @ theta)


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    source, lang = rng.integers(0, 4, n), rng.integers(0, 3, n)
    docs = [(i, "word " * int(rng.integers(1, 300)), f"l{lang[i]}", f"s{source[i]}") for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    target = {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}
    got = m.rates(df, target).toPandas().sort_values("doc_id")
    want = brute(source, lang, got.n_tokens.values.astype(float), np.array([0.1, 0.2, 0.3, 0.4]), m.RIDGE)
    assert np.allclose(got.rate, want, rtol=1e-4)
    share = (got.rate * got.n_tokens).groupby(got.source).sum() / got.n_tokens.sum()
    assert np.allclose(share.sort_index(), [0.1, 0.2, 0.3, 0.4], rtol=1e-5)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()
    made = (got.copies * got.n_tokens).groupby(got.source).sum() / got.n_tokens.sum()
    assert np.allclose(made.sort_index(), [0.1, 0.2, 0.3, 0.4], rtol=0.12)
    twice = m.rates(df, target).toPandas().sort_values("doc_id")
    assert (twice.copies.values == got.copies.values).all()


def test_one_source_far_off_and_left_out(spark):
    docs = [(i, "tok " * (5 + i % 50), "en", "big" if i % 10 else "rare") for i in range(300)] + [(900, "x y z", "de", "gone")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = m.rates(df, {"big": 0.1, "rare": 0.9, "absent": 3.0}).toPandas()
    share = (got.rate * got.n_tokens).groupby(got.source).sum() / got.n_tokens.sum()
    assert np.allclose(share[["big", "rare", "gone"]], [0.1, 0.9, 0], atol=1e-5)
    with pytest.raises(ValueError):
        m.rates(df, {"absent": 1.0})


def test_documents_reach_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = m.rates(docs).toPandas()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    want = share**m.TEMPER / (share**m.TEMPER).sum()
    assert np.allclose((got.rate * got.n_tokens).groupby(got.source).sum() / got.n_tokens.sum(), want, rtol=1e-5)


def test_hard_rows(spark):
    rows = [(1, None, "en", "a", 7), (2, "", "en", "a", 7), (None, "some words", None, None, 7), (3, "same row", "en", "b", 7), (3, "same row", "en", "b", 7), (4, "word " * 30_000, "en", "b", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __rate int")
    got = m.rates(df).toPandas()
    assert len(got) == 6 and (got[got.n_tokens == 0].copies == 0).all() and got[got.doc_id == 3].copies.nunique() == 1
    out = m.remixed(df)
    assert out.columns == df.columns
    assert out.count() == got.copies.sum()
    empty = spark.createDataFrame([], df.schema)
    assert m.rates(empty).count() == 0 and m.remixed(empty).count() == 0
