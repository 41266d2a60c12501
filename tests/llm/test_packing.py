import numpy as np
import pytest

from loomtext.llm import packing as p
from loomtext.llm._text import encoder, tokenizer_path


def test_nnls_optimality():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random((12, 30)), rng.normal(size=12)
        x = p.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-7).all() and np.allclose(slope[x > 0], 0, atol=1e-7)


def test_combinations():
    found = p.combinations(12, 3)
    want = {tuple(sorted(c, reverse=True)) for a in range(13) for b in range(13) for c in [tuple(x for x in (a, b, 12 - a - b) if x > 0)] if a + b <= 12}
    assert set(found) == {c for c in want if sum(c) == 12} and len(found) == len(set(found))


def first_fit(lengths, room):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, left in enumerate(bins):
            if left >= x:
                bins[i] -= x
                break
        else:
            bins.append(room - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_everything_and_fills_well(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(2.5, 0.9, 3000).astype(int) + 1, 1, 64)
    h = np.bincount(lengths, minlength=65)
    used, windows = np.zeros(65, int), 0
    for part, times in p.plan(h):
        assert sum(part) <= 64 and times > 0
        windows += times
        for x in part:
            used[x] += times
    assert (used == h).all()
    assert windows <= 1.01 * first_fit(lengths.tolist(), 64) + 1


def test_pack_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD_ROWS", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = p.pack(docs).toPandas()
    enc = encoder(tokenizer_path())
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) + 1 for r in docs.collect() if r.text}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    got = got.sort_values(["doc_id", "piece"])
    assert (got.first_token == got.groupby("doc_id").n_tokens.cumsum() - got.n_tokens).all()
    windows = got.sort_values(["window_id", "start"])
    end = windows.start + windows.n_tokens
    same = windows.window_id.values[1:] == windows.window_id.values[:-1]
    assert (end <= p.WINDOW).all() and (windows.start.values[1:][same] >= end.values[:-1][same]).all()
    assert set(windows.window_id) == set(range(windows.window_id.nunique()))
    units = np.ceil(got.n_tokens / p.UNIT).astype(int).tolist()
    assert windows.window_id.nunique() <= 1.02 * first_fit(units, p.WINDOW // p.UNIT) + 1


def test_hard_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "some text", 0), (3, "same", 0), (3, "same", 0), (4, "word " * 9000, 1)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string, units int")).toPandas()
    assert got[got.doc_id == 3].shape[0] == 2 and got.doc_id.isna().sum() == 1 and set(got.doc_id.dropna()) == {3, 4}
    assert not got.duplicated(["window_id", "start"]).any()
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
