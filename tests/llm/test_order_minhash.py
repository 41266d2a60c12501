import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import order_minhash as o
from loomtext.llm._text import Words, flat


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


words = st.lists(st.integers(0, 4), max_size=40)


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 45))
def test_banded_distance(a, b, most):
    d = plain(a, b)
    assert o.banded_distance(a, b, most) == (d if d <= most else most + 1)


def test_banded_distance_of_long_copies():
    rng = random.Random(5)
    for n in (300, 900):
        a = [rng.randrange(500) for _ in range(n)]
        b = list(a)
        for _ in range(n // 6):
            p = rng.randrange(len(b))
            b[p : p + rng.randrange(2)] = [rng.randrange(500)] * rng.randrange(2)
        d = plain(a, b)
        assert o.banded_distance(a, b, d) == d and o.banded_distance(a, b, d - 1) == d and o.banded_distance(a, b, n) == d


def test_sketch_is_the_definition():
    texts = ["the cat sat on the mat and the cat sat on the hat", "one two", "", "a b c", "x " * 50]
    raw, off = flat(pa.array(texts))
    w = Words(raw, off)
    rows, keys = o.sketch(w)
    assert list(rows) == [0, 1, 3, 4] and keys.shape == (4, o.BANDS)
    for i, t in enumerate(texts):  # a document alone gives the same keys
        raw, off = flat(pa.array([t]))
        r, k = o.sketch(Words(raw, off))
        assert (len(r) == 0) == (i == 2)
        if len(r):
            assert np.array_equal(k[0], keys[list(rows).index(i)])
    swapped = "the cat sat on the hat and the cat sat on the mat"
    raw, off = flat(pa.array([swapped]))
    assert (o.sketch(Words(raw, off))[1][0] != keys[0]).any()


def word_lists(docs):
    return o._sketches(docs.selectExpr("id", "0L AS text_hash", "text")).select("id", "words")


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    docs = {}
    for base in range(40):
        text = [rng.choice(vocab) for _ in range(rng.randrange(20, 250))]
        docs[len(docs)] = " ".join(text)
        for _ in range(base % 5):
            edited = list(text)
            for _ in range(rng.randrange(max(1, len(text) // 8))):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            docs[len(docs)] = " ".join(edited)
    return docs


def test_groups_against_brute_force(spark):
    docs = corpus()
    lists = {i: t.split() for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i in docs:
        for j in docs:
            longer = max(len(lists[i]), len(lists[j]))
            if i < j and o.banded_distance(lists[i], lists[j], o.allowed(longer)) <= o.allowed(longer):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in docs}
    got = {r.doc_id: r.group_id for r in o.groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    pairs = [(i, j) for i in docs for j in docs if i < j and want[i] == want[j]]
    found = [(i, j) for i, j in pairs if got.get(i, -1) == got.get(j, -2)]
    assert len(pairs) > 50 and len(found) >= 0.9 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items())


def test_hard_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "Same text here, you see", "x"), (2, "same text HERE you see", "y"), (None, "same text here you see", "z"), (3, None, "a"), (4, "", "b"), (5, "?!", "c")]
    rows += [(6, long, "d"), (7, long + " tail", "e"), (8, "alone in the world of words", "f"), (9, "hi", "g"), (10, "hi", "g"), (11, "twice named text of some length", "g"), (11, "twice named text of some length", "g"), (11, "other text under that same name", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, band string")
    got = {(r.doc_id, r.group_id, r.keep) for r in o.groups(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (6, 6, True), (7, 6, False), (9, 9, True), (10, 9, False), (11, 11, True), (11, 11, False)}
    kept = o.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 11, 11]
    assert {r.text for r in kept.filter("doc_id = 11").collect()} == {rows[11][1], rows[13][1]}
    other = spark.createDataFrame([(1, "the same words", "b"), (1, "the same words", "a"), (1, "the same words", None)], "doc_id long, text string, __id string")
    assert [r["__id"] for r in o.keep_one(other).collect()] == ["a"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert o.groups(empty).count() == 0 and o.keep_one(empty).count() == 0


def test_a_bucket_whose_leader_is_unlike_the_rest(spark):
    """Members that fail against a leader are compared with each other."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, a), (2, b), (3, b + " nine"), (4, a + " iota"), (5, "nothing like it at all")], "id long, text string")
    members = spark.createDataFrame([(0, 7, i) for i in range(1, 6)], "band int, key long, id long")
    found = {(r.a, r.b) for r in o._edges(o._led(members), word_lists(docs)).collect()}
    assert found == {(3, 2), (4, 1)}


def test_copies_that_are_near_only_to_their_original(spark):
    """Members that passed against a leader still meet those that failed."""
    rng = random.Random(8)
    original = [f"w{i}" for i in range(100)]
    texts = [original]
    for i in range(12):  # 0.75 to the original, below 0.7 to each other
        copy = list(original)
        for p in rng.sample(range(100), 25):
            copy[p] = f"x{i}y{p}"
        texts.append(copy)
    far = [(i, j) for i in range(1, 13) for j in range(1, i) if plain(texts[i], texts[j]) > 30]
    assert len(far) == 66
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    for key in range(3):  # one bucket under several bands, so with several leaders
        members = spark.createDataFrame([(key, 7, i) for i in range(13)], "band int, key long, id long")
        found = {(r.a, r.b) for r in o._edges(o._led(members), word_lists(docs)).collect()}
        assert found == {(i, 0) for i in range(1, 13)}


def test_counts_never_leave_out_a_near_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, rng.choice([3, 40, 5000]), rng.choice([1, 9, 60, 2000]))
        b = np.delete(a, rng.choice(len(a), rng.integers(0, len(a) // 3 + 1), replace=False))
        b[rng.random(len(b)) < rng.choice([0, 0.1, 0.25])] = 7
        counts = [np.minimum(np.bincount(x % o.BINS, minlength=o.BINS), 255).astype(np.uint8)[None] for x in (a, b)]
        longer = max(len(a), len(b))
        common = sum(min((a == w).sum(), (b == w).sum()) for w in set(a.tolist()))
        if common >= longer - o.allowed(longer):
            assert o._may_be_near(*counts, np.array([len(a)]), np.array([len(b)])).all()


def test_unlike_texts_around_a_common_sentence_are_not_aligned_in_pairs(spark, monkeypatch):
    """A large bucket loses no near pair, and its others don't become rows."""
    monkeypatch.setattr(o, "CHUNK", 64, raising=False)
    rng = random.Random(6)
    text = lambda: ["the", "same", "old", "sentence"] + [f"w{rng.randrange(4000)}" for _ in range(60)]
    texts = [text() for _ in range(240)]
    main = text()
    texts += [[*main[:k], "x", *main[k + 1 :]] for k in range(4, 40)] + [main]
    near = []
    for i in range(0, 60, 6):
        near.append((len(texts), i))
        texts.append([f"y{p}" if p % 5 == 4 else w for p, w in enumerate(texts[i])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    every = spark.createDataFrame([(b, 7, i) for b in range(2) for i in range(len(texts))], "band int, key long, id long")
    tied = spark.createDataFrame([(i, 240) for i in range(241, 277)], "a long, b long")
    found = [(r.a, r.b) for r in o._apart(every, tied, word_lists(docs)).collect()]
    assert set(near) <= set(found) and len(found) == len(set(found)) < 100


def test_recall_of_candidates_by_similarity():
    """Pairs with edits scattered over the whole text share a bucket, at every level down to the threshold."""
    rng = random.Random(4)
    for similarity in (0.7, 0.75, 0.8, 0.85):
        for kind in ("replaced", "left out"):
            texts = []
            for _ in range(150):
                a = [f"w{rng.randrange(5000)}" for _ in range(300)]
                gone = set(rng.sample(range(300), round(300 * (1 - similarity))))
                b = [f"x{p}y{rng.randrange(5000)}" if p in gone else w for p, w in enumerate(a) if kind == "replaced" or p not in gone]
                texts += [" ".join(a), " ".join(b)]
            rows, keys = o.sketch(Words(*flat(pa.array(texts))))
            assert len(rows) == 300
            assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.9, (similarity, kind)
