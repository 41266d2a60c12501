"""Every registered query over whole tables of the smallest scale, against DuckDB where it has SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from loomtext.kernels import markdown, sketch
from loomtext.config import MinHash
from loomtext.plans import registry
from loomtext.sources import tables
from loomtext.operators.lsh import Partition

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def plain(row, names):
    return tuple(0.0 if isinstance(row[c], float) and (math.isnan(row[c]) or row[c] == 0) else row[c] for c in names)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    if name not in registry.SQL:
        assert got
        return
    r = con.sql(registry.SQL[name])
    assert sorted(r.columns) == names
    want = [dict(zip(r.columns, x)) for x in r.fetchall()]
    key = lambda rows: sorted((plain(x, names) for x in rows), key=repr)
    assert key(got) == key(want)


def test_pairs_against_all_pairs(spark, con):
    docs = con.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    found, _ = sketch.minhash([t for _, t in docs], MinHash())
    p = Partition.for_threshold(0.7, 128)
    want = set()
    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            equal = found[i] == found[j]
            if equal.mean() >= 0.7 and equal.reshape(p.bands, p.rows).all(axis=1).any():
                want.add((docs[i][0], docs[j][0]))
    got = {(r.a, r.b) for r in registry.near_duplicate_pairs(spark, DATA).collect()}
    assert got == want and len(want) > 10


def test_extraction_rows(spark, con):
    pages = {r.page_id: r.text for r in registry.html_text(spark, DATA).collect()}
    for i, page in con.sql("SELECT page_id, html FROM pages").fetchall():
        assert "<script" not in pages[i] and "<p" not in pages[i]
    plain_ = {r.doc_id: r.plain for r in registry.markdown_text(spark, DATA).collect()}
    assert plain_ == {i: markdown.text(t) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    items = dict(con.sql("SELECT item_id, text FROM benchmark").fetchall())
    assert {r.item_id: r.text for r in registry.pdf_text(spark, DATA).collect()} == {i: t.strip() for i, t in items.items()}


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("# Head\n\ntext")
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text("<p>para<script>x")
    assert tables.text_files(spark, str(tmp_path / "t")).first().text == "one\ntwo"
    assert tables.markdown_files(spark, str(tmp_path / "m")).first().text == "Head text"
    assert tables.html_files(spark, str(tmp_path / "h")).first().text == "para"
    docs = tables.parquet_documents(spark, f"{DATA}/documents.parquet", "doc_id", "text")
    from loomtext.functions.sketches import minhash

    sigs = docs.select("id", minhash("text", MinHash(32), "null").alias("sig"))
    tables.write_index(sigs, str(tmp_path / "index"), Partition(4, 8))
    s, b = tables.read_index(spark, str(tmp_path / "index"))
    assert s.count() == 200 and b.count() == 800 and b.columns == ["band", "key", "id"]


def test_pdf_files(spark, tmp_path):
    from loomtext.kernels import pdf
    from loomtext.streaming.chunked import as_pdf

    row = spark.sql("SELECT 'Hello there' t").select(as_pdf("t").alias("p")).first()
    (tmp_path / "a.pdf").write_bytes(bytes(row.p))
    (tmp_path / "b.pdf").write_bytes(b"x" * 5000)
    (tmp_path / "c.pdf").write_bytes(b"not one")
    got = {r.id.rsplit("/", 1)[1]: r for r in tables.pdf_files(spark, str(tmp_path), pdf.Options(max_bytes=2000)).collect()}
    assert got["a.pdf"].text == "Hello there" and "larger" in got["b.pdf"].error and got["c.pdf"].error == "not a PDF file"


def test_benchmark_lookup_against_all_pairs(spark, con):
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    sigs, _ = sketch.minhash([t for _, t in docs], MinHash())
    probes, _ = sketch.minhash([t for _, t in items], MinHash())
    want = {(i, d) for (i, _), p in zip(items, probes) if p is not None for (d, _), s in zip(docs, sigs) if s is not None and (p == s).mean() >= 0.3}
    got = {(r.probe, r.id) for r in registry.lsh_lookup_benchmark(spark, DATA).collect()}
    narrow = {(r.probe, r.id) for r in registry.lsh_query_benchmark(spark, DATA).collect()}
    print("pairs", len(want), "found", len(want & got), "narrow found", len(want & narrow))
    assert want and got <= want and len(got) >= 0.95 * len(want)
