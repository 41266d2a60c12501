import random

import pytest

from loomtext.llm import winnowing as w


def brute(text, k, window):
    """Straight from the definition: hash every run, take each window's minimum, rightmost on ties."""
    kept = [(i, ord(c.lower()) if len(c.lower()) == 1 else ord(c)) for i, c in enumerate(text) if c.isalnum()]
    hashes = []
    for i in range(len(kept) - k + 1):
        h = 0
        for base in w.BASES:
            h = (h << 31) | sum(kept[i + j][1] * pow(base, j, w.PRIME) for j in range(k)) % w.PRIME
        hashes.append((h, kept[i][0]))
    out = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        span = hashes[i : i + window]
        low = min(h for h, _ in span)
        out.add(max((p, h) for h, p in span if h == low))
    return sorted(out)


def got(texts, k, window):
    row, pos, h = w.winnow(texts, k, window)
    return [sorted((int(p), int(x)) for r, p, x in zip(row, pos, h) if r == i) for i in range(len(texts))]


@pytest.mark.parametrize("k,window", [(3, 4), (5, 1), (4, 7), (25, 40)])
def test_equals_definition(k, window):
    rng = random.Random(1)
    texts = ["", None, "a", "ab!c", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 4, "Straße ÉÇ İß 中文 " * 9]
    texts += ["".join(rng.choice("abAB é.1\n") for _ in range(rng.randrange(300))) for _ in range(40)]
    assert got(texts, k, window) == [brute(t or "", k, window) for t in texts]


def test_shared_passage_is_found():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(w.K + w.WINDOW - 1)
    a, b = (set(int(h) for h in w.winnow([word(200) + passage + word(300)])[2]) for _ in range(2))
    assert a & b


def test_frame(spark):
    text = "The quick brown fox jumps over the lazy dog and runs away from it, again and again."
    rows = [(1, text, 5), (1, text, 5), (None, text, 6), (2, None, 7), (3, "", 8), (4, "short", 9), (5, text * 3000, 1)]
    out = w.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, position int")).toPandas()
    one = out[out.doc_id == 1]
    assert len(one) == 2 * len(one.drop_duplicates()) > 0
    assert out.doc_id.isna().sum() == len(one) // 2
    assert set(out.doc_id.dropna()) == {1, 5}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert w.fingerprints(empty).count() == 0
