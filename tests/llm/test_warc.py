import io
import random

import pytest

from loomtext.llm import warc as w


def blob(n, seed=0, level=6):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abc<>é") for _ in range(rng.randrange(3000))) for _ in range(n)]
    return texts, [w.member(w.record(i, f"http://x/{i}", t), level) for i, t in enumerate(texts)]


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**9])
def test_every_record_is_owned_once(split):
    texts, parts = blob(25)
    data = b"".join(parts)
    found = []
    for start in range(0, len(data), split):
        for offset, content in w.members(io.BytesIO(data), start, min(start + split, len(data))):
            found += [(offset, h["x-page-id"], block.partition(b"\r\n\r\n")[2].decode()) for h, block in w._parse(content)]
        if split == 1 and start > 3000:
            break
    want, at = [], 0
    for i, (t, p) in enumerate(zip(texts, parts)):
        want.append((at, str(i), t))
        at += len(p)
    assert found == (want if split > 1 else [x for x in want if x[0] <= start])


def test_false_magic_and_damage():
    texts, parts = blob(6, 1)
    fake = w.MAGIC + b"\x00" * 7 + w.member(b"not a record") + w.MAGIC
    broken = parts[2][:-9] + b"\x00" * 9
    data = parts[0] + fake + parts[1] + broken + parts[3] + w.member(w.record(7, "u", "p") + w.record(8, "v", "q")) + parts[4][:40]
    for split in (50, 400, 10**6):
        ids = [h["x-page-id"] for s in range(0, len(data), split) for _, c in w.members(io.BytesIO(data), s, min(len(data), s + split)) for h, _ in w._parse(c)]
        assert ids == ["0", "1", "3", "7", "8"]


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é?x=1%20y", "<p>ü</p>"), (2, None, "no address"), (3, "http://b/\r\nX: y", None), (None, " spaced ", ""), (4, "u", "x" * 3_000_000), (5, "same", "row"), (5, "same", "row")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS offset").coalesce(1)
    folder = str(tmp_path / "w")
    manifest = w.write_warc(df, folder)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    key = lambda r: (r[0] or 0, str(r[1]))
    for split in (300, 1000, 1 << 24):
        got = [tuple(r) for r in w.pages_of(w.read_warc(manifest, split)).collect()]
        assert sorted(got, key=key) == sorted(rows, key=key)
    listed = w.warc_files(spark, folder)
    assert w.read_warc(listed, 500).filter("record_type = 'response'").count() == 6
    assert w.read_warc(w.write_warc(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_pages(spark):
    got = {tuple(r) for r in w.op7_warc(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
