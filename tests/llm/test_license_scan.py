import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import license_scan as ls


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25), st.lists(st.integers(0, 5), min_size=1, max_size=12))
def test_alignment(words, template):
    matched, first, last = ls.aligned(words, template)
    assert matched == subsequence(words, template)
    if matched:
        assert subsequence(words[first : last + 1], template) == matched


def test_planted_notices(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(ls.TEMPLATES.items()):
        before = rng.randrange(60)
        n = len(ls._words(text).hash)
        rows.append((i, f"{noise(before)} {text.upper()}\n{noise(rng.randrange(60))}", name))
        want.add((i, name, before, before + n - 1))
    long = ls.TEMPLATES["mit"].split()
    del long[40]
    long[80:80] = ["really", "truly"]
    rows.append((100, " ".join(long), "edited"))
    rows += [(200 + i, noise(400), "clean") for i in range(20)]
    rows += [(300, None, ""), (301, "", ""), (302, "?", ""), (303, "the license under the mit", ""), (None, "x All rights reserved.", "")]
    rows += [(304, "All rights reserved. " + noise(20_000) + " all rights reserved", "twice")] * 2
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string, template string")).toPandas()
    found = {tuple(r) for r in got[["doc_id", "template", "first_word", "last_word"]].itertuples(index=False) if r[0] < 100}
    assert found == want
    assert list(got[got.doc_id == 100].template) == ["mit"]
    assert not set(range(200, 304)) & set(got.doc_id.dropna())
    assert got.doc_id.isna().sum() == 1
    assert sorted(got[got.doc_id == 304].first_word) == [0, 20_003]


def test_empty(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_notice_of_the_documents(spark):
    """Against a plain search for the short notices in the normalised text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.template) for r in ls.scan(docs).collect()}
    want = set()
    for r in docs.collect():
        words = " " + " ".join("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (r.text or "").lower()).split()) + " "
        for name in ("notice-apache-2.0", "notice-mit", "notice-gpl-3.0", "notice-cc-by-nc-4.0", "notice-all-rights-reserved"):
            text = " ".join("".join(c if c.isalnum() else " " for c in ls.TEMPLATES[name].lower()).split())
            if f" {text} " in words:
                want.add((r.doc_id, name))
    assert want and got == want


def test_notices_with_insertions_and_short_ones(spark):
    """All that verification accepts has enough votes, whatever way the words are spread."""
    rng = random.Random(6)
    def spread(text, pieces, words, drop=0):  # foreign words between equal parts
        own = text.split()
        for p in sorted(rng.sample(range(1, len(own) - 1), drop), reverse=True):
            del own[p]
        for i in range(pieces, 0, -1):
            at = i * len(own) // (pieces + 1)
            own[at:at] = [f"zz{i}q{j}" for j in range(words)]
        return "some words before " + " ".join(own) + " and some behind"
    rows = [(1, spread(ls.TEMPLATES["mit"], 8, 4)), (2, spread(ls.TEMPLATES["apache-2.0-header"], 5, 3)), (3, "x Released under MIT License y")]
    rows += [(4, spread(ls.TEMPLATES["mit"], 25, 1, drop=20)), (5, "x all rights are reserved y"), (6, spread(ls.TEMPLATES["mit"], 15, 4))]
    got = {(r.doc_id, r.template) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "mit"), (2, "apache-2.0-header"), (3, "notice-mit"), (4, "mit"), (5, "notice-all-rights-reserved")} <= got
    assert (6, "mit") not in got  # 60 foreign words are too many
