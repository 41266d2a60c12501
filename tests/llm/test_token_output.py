import glob

import pyarrow.parquet as pq
import pytest

from loomtext.llm import token_output as to
from loomtext.llm._text import encoder, tokenizer_path


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_round_trip_and_layout(spark, tmp_path, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / encoding)
    to.write_tokens(to.tokenized(docs.repartition(2)), path, encoding, group_bytes=64 << 10, page_bytes=4 << 10)
    enc = encoder(tokenizer_path())
    texts = {r.doc_id: r for r in docs.collect()}
    back = to.read_tokens(spark, path).collect()
    assert len(back) == len(texts)
    for r in back:
        assert enc.decode(r.tokens) == texts[r.doc_id].text and r.n_tokens == len(r.tokens)
        assert (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source)
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = columns["tokens.list.element"]
            assert ("DELTA_BINARY_PACKED" in tokens.encodings) == (encoding == "delta")
            assert tokens.has_offset_index and columns["doc_id"].has_column_index
    some = to.read_tokens(spark, path).filter("doc_id = 7").select("n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "tokens:array" not in plan
    assert [r.n_tokens for r in some.collect()] == [len(enc.encode_ordinary(texts[7].text))]


def test_hard_rows(spark, tmp_path):
    long = "word ñandú 中文 \n" * 40_000
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 2), (None, "x", None, None, 3), (4, "<|endoftext|> is text", "en", "s", 4), (4, "<|endoftext|> is text", "en", "s", 4), (5, long, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    to.write_tokens(to.tokenized(docs), str(tmp_path / "t"))
    got = {r.doc_id: r for r in to.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert got[1].tokens is None and got[1].n_tokens is None and got[2].tokens == [] and got[2].n_tokens == 0
    enc = encoder(tokenizer_path())
    assert enc.decode(got[5].tokens) == long and enc.decode(got[4].tokens) == rows[3][1] and got[None].n_tokens == 1
    empty = docs.limit(0)
    to.write_tokens(to.tokenized(empty), str(tmp_path / "e"))
    assert to.read_tokens(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        to.write_tokens(to.tokenized(docs), str(tmp_path / "x"), "plain")
