"""Registered queries over whole tables, and the same in SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.config import GRAPHEMES, MURMUR3, WORDS, Canonical, MinHash, SimHash, Tokens, config_hash_of
from loomtext.functions import sketches as S
from loomtext.functions import text as X
from loomtext.functions import vectors as V
from loomtext.operators import corpus, lsh
from loomtext.operators import sketches as K
from loomtext.plans import sql as q
from loomtext.session import spread, table, written
from loomtext.streaming import chunked

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Narrow signatures where SQL has to follow, the usual width elsewhere.
NARROW = MinHash(slots=32, family=MURMUR3)
WIDE = MinHash(family=MURMUR3)
PART = lsh.Partition.for_threshold(0.7, 32)
THRESHOLD = 0.7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def signed(spark: SparkSession, sf_dir: str, config: MinHash) -> DataFrame:
    """id, sig of every document that has one, written once for plans that read it several times."""
    return written(keyed(spark, sf_dir).select("id", S.minhash("text", config, "null").alias("sig")), "signatures").filter("sig IS NOT NULL")


def rounded(c, n: int = 4):
    return F.round(c.cast("double"), n) + F.lit(0.0)  # no negative zero


# canonical form and tokens


@query(f"SELECT doc_id, {q.canonical()} AS canonical FROM documents")
def canonical_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.canonicalize("text").alias("canonical"))


@query(f"SELECT doc_id, nfc_normalize({q.strip('text')}) AS nfc, {q.strip('text')} AS stripped, regexp_replace(text, '[\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}\\x{{200E}}\\x{{200F}}]', '', 'g') AS no_bidi, lower({q.strip('text')}) AS folded FROM documents")
def canonical_variants(spark, sf_dir):
    nothing = Canonical("none", False, False, False)
    variants = {"nfc": Canonical("nfc", case_fold=False), "stripped": Canonical("none", False), "no_bidi": Canonical("none", False, True, False)}
    c = [X.canonicalize("text", v).alias(k) for k, v in variants.items()] + [X.canonicalize(F.lower(X.canonicalize("text", Canonical("none", False))), nothing).alias("folded")]
    return documents(spark, sf_dir).select("doc_id", *c)


@query("SELECT strlen(text) = length(text) AS ascii, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def ascii_texts(spark, sf_dir):
    ascii_ = (F.octet_length("text") == F.char_length("text")).alias("ascii")
    return documents(spark, sf_dir).groupBy(ascii_).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("bigint").alias("chars"))


@query()
def confusable_skeletons(spark, sf_dir):
    """The canonical text with look-alike characters replaced; rows as canonical_text."""
    return documents(spark, sf_dir).select("doc_id", X.canonicalize("text", Canonical(confusable=True)).alias("skeleton"))


@query(f"WITH {q.word_lists()} SELECT id AS doc_id, unnest(ws) AS token, generate_subscripts(ws, 1)::INTEGER - 1 AS pos FROM lists")
def word_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.tokens("text", WORDS, Canonical())).alias("pos", "token"))


@query(f"WITH {q.word_lists()} SELECT id AS doc_id, len(ws)::INTEGER AS n_words FROM lists")
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.token_count("text", WORDS, Canonical()).alias("n_words"))


@query("SELECT doc_id, length_grapheme(text)::INTEGER AS n_graphemes FROM documents")
def grapheme_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.token_count("text", GRAPHEMES).alias("n_graphemes"))


@query(f"WITH {q.word_lists()}, s AS (SELECT id, {q.shingles('ws', 5)} AS s FROM lists) SELECT id AS doc_id, len(s)::INTEGER AS n, len(list_distinct(s))::INTEGER AS n_distinct, md5(array_to_string(s, '|')) AS digest FROM s")
def shingles_k5(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", X.tokens("text", WORDS, Canonical()).alias("w"))
    s = words.select("doc_id", X.shingles("w", 5).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.size(F.array_distinct("s")).alias("n_distinct"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"WITH {q.word_lists()}, a AS (SELECT id, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 2, 1) END AS n FROM lists) SELECT id AS doc_id, (CASE WHEN n = 0 THEN 0 ELSE greatest(n - 1, 1) END)::INTEGER AS n FROM a")
def nested_shingles(spark, sf_dir):
    """Pairs of word triples."""
    return documents(spark, sf_dir).select("doc_id", X.token_count("text", Tokens(shingle=(3, 2)), Canonical()).alias("n"))


@query(f"SELECT doc_id, len(ws)::INTEGER AS cjk_lindera_ipadic, len(ws)::INTEGER AS cjk_lindera_ko_dic FROM (SELECT doc_id, {q.words('text')} AS ws FROM documents)")
def cjk_tokens(spark, sf_dir):
    """Japanese and Korean, by the word rules; the Chinese dictionary is not installed."""
    kinds = [k for k in Tokens.KINDS if k.startswith("cjk-lindera")]
    return documents(spark, sf_dir).select("doc_id", *[X.token_count("text", Tokens(k)).alias(k.replace("-", "_")) for k in kinds])


@query(f"WITH {q.word_lists()} SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(ws) AS token FROM lists) GROUP BY token")
def document_frequency(spark, sf_dir):
    return K.document_frequency(documents(spark, sf_dir))


@query(f"WITH {q.word_lists()}, n AS (SELECT count(*) AS n FROM lists WHERE len(ws) > 0) SELECT token, round(ln(any_value(n) / count(DISTINCT id)), 4) AS idf FROM (SELECT id, unnest(ws) AS token FROM lists), n GROUP BY token")
def idf_weights(spark, sf_dir):
    return K.idf_table(documents(spark, sf_dir)).select("token", rounded(F.col("idf")).alias("idf"))


# hashes and sketches


@query(f"WITH {q.word_lists()}, t AS (SELECT DISTINCT unnest(ws) AS tok FROM lists), {q.digests('t')} SELECT tok AS token, {q.hex16('lo')} AS low, {q.hex16('hi')} AS high FROM digests")
def murmur_digests(spark, sf_dir):
    t = K.document_frequency(documents(spark, sf_dir)).select("token", S.hash_tokens(F.array("token"), MURMUR3, WIDE.seed)[0].alias("h"))
    return t.select("token", S.hex64(F.col("h.low")).alias("low"), S.hex64(F.col("h.high")).alias("high"))


@query(f"WITH {q.signatures(128)} SELECT id AS doc_id, md5(array_to_string(list_transform(sig, lambda x: {q.hex16('x')}), '')) AS digest FROM sigs")
def minhash_murmur(spark, sf_dir):
    """Signatures of 128 slots over 5-shingles, digested."""
    sig = documents(spark, sf_dir).select("doc_id", S.minhash("text", WIDE, "null").alias("sig")).filter("sig IS NOT NULL")
    return sig.select("doc_id", F.md5(F.array_join(F.transform("sig.hashes", S.hex64), "").cast("binary")).alias("digest"))


@query()
def minhash_default(spark, sf_dir):
    """The default family; SQL has no such hash."""
    m = documents(spark, sf_dir).select("doc_id", S.minhash("text").alias("m"))
    return m.select("doc_id", S.show_minhash("m.sig").alias("shown"), "m.sig", "m.error")


@query(f"WITH {q.signatures(32)}, e AS (SELECT source, generate_subscripts(sig, 1) AS i, unnest(sig) AS s FROM sigs JOIN documents ON doc_id = id), m AS (SELECT source, i, min(s) AS s FROM e GROUP BY ALL) SELECT source, md5(string_agg({q.hex16('s')}, '' ORDER BY i)) AS digest FROM m GROUP BY source")
def source_signatures(spark, sf_dir):
    """The signature of each source's union of documents."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", S.minhash("text", NARROW, "null").alias("sig"))
    u = K.union_signatures(docs, "source", "sig", NARROW.slots)
    return u.select("source", F.md5(F.array_join(F.transform("sig.hashes", S.hex64), "").cast("binary")).alias("digest"))


_TERMS = f"{q.word_lists()}, terms AS MATERIALIZED (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest(ws) AS tok FROM lists) GROUP BY ALL), {q.digests('terms')}"


def _simhash(spark, sf_dir, weighting):
    s = documents(spark, sf_dir).select("doc_id", S.simhash("text", SimHash(weighting=weighting, family=MURMUR3), on_error="null").alias("s")).filter("s IS NOT NULL")
    return s.select("doc_id", S.hex64(F.col("s")).alias("simhash"))


@query(f"WITH {_TERMS}, {q.simhash('tf')} SELECT id AS doc_id, {q.hex16('simhash')} AS simhash FROM prints")
def simhash_tf(spark, sf_dir):
    return _simhash(spark, sf_dir, "tf")


@query(f"WITH {_TERMS}, {q.simhash('1')} SELECT id AS doc_id, {q.hex16('simhash')} AS simhash FROM prints")
def simhash_uniform(spark, sf_dir):
    return _simhash(spark, sf_dir, "uniform")


@query(f"WITH {_TERMS}, n AS (SELECT count(*) AS n FROM lists WHERE len(ws) > 0), idf AS (SELECT tok, ln(any_value(n) / count(*))::FLOAT AS idf FROM terms, n GROUP BY tok), {q.simhash('trunc((tf::FLOAT * idf)::FLOAT)::BIGINT').replace('JOIN digests', 'JOIN idf USING (tok) JOIN digests')} SELECT id AS doc_id, {q.hex16('simhash')} AS simhash FROM prints")
def simhash_idf(spark, sf_dir):
    docs = keyed(spark, sf_dir)
    idf = written(K.idf_table(docs), "idf")
    return K.simhash_by_idf(docs, idf, SimHash(weighting="idf", family=MURMUR3)).select(F.col("id").alias("doc_id"), S.hex64(F.col("simhash")).alias("simhash"))


@query()
def simhash_default(spark, sf_dir):
    m = documents(spark, sf_dir).select("doc_id", S.simhash("text").alias("m"))
    return m.select("doc_id", S.show_simhash("m.sig").alias("shown"), "m.error")


@query(f"WITH {_TERMS}, {q.simhash('tf')} SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash))::INTEGER AS distance, round(cos(bit_count(xor(x.simhash, y.simhash)) / 64.0 * pi()), 4) AS cosine FROM prints x JOIN prints y ON x.id < y.id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3")
def hamming_pairs(spark, sf_dir):
    """All pairs of documents whose SimHashes differ in at most 3 bits."""
    prints = keyed(spark, sf_dir).select("id", S.simhash("text", SimHash(family=MURMUR3), on_error="null").alias("simhash"))
    pairs = K.hamming_pairs(written(prints, "simhash").filter("simhash IS NOT NULL"), 3)
    return pairs.select("a", "b", F.col("distance").cast("int").alias("distance"), F.round(F.cos(F.col("distance") / 64.0 * F.pi()), 4).alias("cosine"))


@query()
def tlsh_digests(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", S.tlsh_digest("text").alias("t"))
    return t.select("doc_id", "t.digest", "t.error", S.is_tlsh("t.digest").alias("valid"))


@query()
def tlsh_distances(spark, sf_dir):
    """Of near-duplicate pairs."""
    pairs = near_duplicate_pairs(spark, sf_dir).select("a", "b")
    d = written(keyed(spark, sf_dir).select("id", S.tlsh_digest("text", on_error="null").alias("d")), "digests")
    both = pairs.join(d.select(F.col("id").alias("a"), F.col("d").alias("x")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("y")), "b")
    return both.select("a", "b", S.tlsh_distance("x", "y", "null").alias("distance"))


# the index

_BANDED = f"{q.signatures(32)}, {q.bands('bands', PART)}"
_PAIRS = "pairs AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"


@query(f"WITH {_BANDED}, s AS (SELECT band, key, count(*) AS size FROM bands GROUP BY ALL) SELECT band::INTEGER AS band, size, count(*) AS buckets FROM s GROUP BY ALL")
def lsh_bucket_sizes(spark, sf_dir):
    b = lsh.buckets(signed(spark, sf_dir, NARROW), PART).groupBy("band", "key").agg(F.count("*").alias("size"))
    return b.groupBy("band", "size").agg(F.count("*").alias("buckets"))


@query(f"WITH {_BANDED}, {_PAIRS} SELECT a, b FROM pairs")
def lsh_candidates(spark, sf_dir):
    sigs = signed(spark, sf_dir, NARROW)
    return lsh.query(sigs, lsh.buckets(sigs, PART), PART).filter("probe < id").select(F.col("probe").alias("a"), F.col("id").alias("b"))


@query(f"WITH {_BANDED}, {_PAIRS} SELECT a, b, round({q.equal_slots('x.sig', 'y.sig')} / 32.0, 4) AS jaccard FROM pairs JOIN sigs x ON x.id = a JOIN sigs y ON y.id = b WHERE {q.equal_slots('x.sig', 'y.sig')} / 32.0 >= {THRESHOLD}")
def lsh_similar_pairs(spark, sf_dir):
    pairs = lsh.similar_pairs(signed(spark, sf_dir, NARROW), PART, THRESHOLD)
    return pairs.select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


@query()
def near_duplicate_pairs(spark, sf_dir):
    """The flagship: 128 slots of the default family, banded for 0.7, verified."""
    pairs = lsh.similar_pairs(signed(spark, sf_dir, MinHash()), lsh.Partition.for_threshold(THRESHOLD, 128), THRESHOLD)
    return pairs.select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


_PROBES = f"{_BANDED}, {q.signatures(32, table='benchmark', key='item_id', name='probes')}, {q.bands('probe_bands', PART, 'probes')}"


@query(f"WITH {_PROBES}, c AS (SELECT DISTINCT p.id AS probe, b.id AS id FROM probe_bands p JOIN bands b ON p.band = b.band AND p.key = b.key) SELECT probe, id, round({q.equal_slots('p.sig', 's.sig')} / 32.0, 4) AS jaccard FROM c JOIN probes p ON p.id = probe JOIN sigs s ON s.id = c.id WHERE {q.equal_slots('p.sig', 's.sig')} / 32.0 >= 0.3".replace("SELECT probe, id,", "SELECT probe, c.id AS id,"))
def lsh_query_benchmark(spark, sf_dir):
    """Benchmark items looked up in the documents' index."""
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.minhash("text", NARROW, "null").alias("sig"))
    found = lsh.query_verified(probes, signed(spark, sf_dir, NARROW), PART, 0.3)
    return found.select("probe", "id", rounded(F.col("jaccard")).alias("jaccard"))


@query()
def lsh_lookup_benchmark(spark, sf_dir):
    """lsh_query_benchmark in full: 128 slots in 64 bands of 2, of which a pair at Jaccard 0.3 misses all with chance 0.002."""
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.minhash("text", MinHash(), "null").alias("sig"))
    found = lsh.query_verified(probes, signed(spark, sf_dir, MinHash()), lsh.Partition(64, 2), 0.3)
    return found.select("probe", "id", rounded(F.col("jaccard")).alias("jaccard"))


@query(f"WITH {_BANDED} SELECT b.band::INTEGER AS band, count(*) AS postings, count(DISTINCT b.key) AS buckets FROM bands b WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY b.band")
def lsh_remove(spark, sf_dir):
    """The index without the documents labelled toxic."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    left = lsh.remove(lsh.buckets(signed(spark, sf_dir, NARROW), PART), gone)
    return left.groupBy("band").agg(F.count("*").alias("postings"), F.countDistinct("key").alias("buckets"))


@query(f"WITH {_PROBES}, merged AS (SELECT id, sig FROM probes UNION ALL SELECT id, sig FROM sigs WHERE id NOT IN (SELECT id FROM probes)) SELECT id, md5(array_to_string(list_transform(sig, lambda x: {q.hex16('x')}), '')) AS digest FROM merged")
def lsh_replace(spark, sf_dir):
    """Benchmark items inserted under their numbers over the documents'."""
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.minhash("text", NARROW, "null").alias("sig"))
    out = lsh.insert(signed(spark, sf_dir, NARROW), new)
    return out.select("id", F.md5(F.array_join(F.transform("sig.hashes", S.hex64), "").cast("binary")).alias("digest"))


_CHOSEN = {(0.3, 128): (32, 4), (0.5, 128): (32, 4), (0.7, 128): (16, 8), (0.8, 128): (8, 16), (0.85, 128): (8, 16), (0.9, 128): (4, 32), (0.3, 64): (32, 2), (0.5, 64): (16, 4), (0.7, 64): (8, 8), (0.8, 64): (4, 16), (0.9, 64): (4, 16), (0.3, 256): (64, 4), (0.5, 256): (32, 8), (0.7, 256): (32, 8), (0.85, 256): (16, 16), (0.9, 256): (8, 32)}


@query("SELECT * FROM (VALUES " + ", ".join(f"({t}::DOUBLE, {h}, {b}, {r})" for (t, h), (b, r) in _CHOSEN.items()) + ") v(threshold, slots, bands, n_rows)")
def lsh_partitions(spark, sf_dir):
    chosen = [(t, h, lsh.Partition.for_threshold(t, h)) for t, h in _CHOSEN]
    return spark.createDataFrame([(t, h, p.bands, p.rows) for t, h, p in chosen], "threshold double, slots int, bands int, n_rows int")


# metadata and serial forms


@query("SELECT kind AS algorithm, name, count(*) AS n, max(bytes)::BIGINT AS byte_size FROM (SELECT unnest(['minhash-h128', 'simhash-b64']) AS kind, unnest(['minhash-h128-v1', 'simhash-b64-v1']) AS name, unnest([1032, 8]) AS bytes FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')) GROUP BY ALL")
def fingerprint_metadata(spark, sf_dir):
    d = documents(spark, sf_dir).select(S.minhash("text", on_error="null").alias("m"), S.simhash("text", on_error="null").alias("s"))
    prints = d.select(F.explode(F.array(S.fingerprint(minhash=F.col("m")), S.fingerprint(simhash=F.col("s")))).alias("f")).filter("f IS NOT NULL")
    rows = prints.select(S.metadata("f").alias("m"), S.name("f").alias("name"))
    return rows.groupBy("m.algorithm", "name").agg(F.count("*").alias("n"), F.max("m.byte_size").alias("byte_size"))


@query()
def config_hashes(spark, sf_dir):
    configs = [MinHash(), WIDE, NARROW, SimHash(), SimHash(family=MURMUR3)]
    rows = [(c.canonical.name(), c.tokens.name(), c.algorithm(), c.family, config_hash_of(c)) for c in configs]
    return spark.createDataFrame(rows, "canonical string, tokens string, algorithm string, family string, config_hash bigint")


@query(f"WITH {q.signatures(32)} SELECT id AS doc_id, '{{\"schema\":1,\"hashes\":[' || array_to_string(sig, ',') || ']}}' AS json, 264 AS n_bytes, true AS json_back, true AS bytes_back FROM sigs")
def signature_forms(spark, sf_dir):
    """JSON and bytes of every signature, and whether they read back as it was."""
    s = signed(spark, sf_dir, NARROW).withColumns({"json": S.minhash_json("sig"), "bytes": S.minhash_bytes("sig")})
    s = s.withColumns({"j": S.minhash_from_json("json", 32, "null"), "b": S.minhash_from_bytes("bytes", 32, "null")})
    return s.select(F.col("id").alias("doc_id"), "json", F.octet_length("bytes").alias("n_bytes"), (F.col("j") == F.col("sig")).alias("json_back"), (F.col("b") == F.col("sig")).alias("bytes_back"))


# extraction and splitting


@query("SELECT page_id, regexp_replace(html, '(?is)<script.*?(?:</script>|\\z)|<style.*?(?:</style>|\\z)', '', 'g') AS visible FROM pages")
def html_visible(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.visible_html("html").alias("visible"))


@query()
def html_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", X.html_to_text("html").alias("text"))


@query()
def markdown_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.markdown_to_text("text").alias("plain"))


@query()
def pdf_text(spark, sf_dir):
    """Each benchmark item set as a PDF file, and its text out of it."""
    made = table(spark, sf_dir, "benchmark").select("item_id", "text", chunked.as_pdf("text").alias("content"))
    return made.select("item_id", X.pdf_to_text("content").alias("p")).select("item_id", "p.text", "p.error")


@query(f"WITH {q.word_lists()}, w AS (SELECT id, unnest(list_transform(range(0, greatest(0, ceil((len(ws) - 76) / 62.0))::BIGINT + 1), lambda i: [i, array_length(ws)])) AS p, ws FROM lists WHERE len(ws) > 0) SELECT id AS doc_id, p[1]::INTEGER AS chunk, md5(array_to_string(ws[p[1] * 62 + 1:p[1] * 62 + 76], ' ')) AS digest FROM w")
def chunk_fixed(spark, sf_dir):
    """Windows of 100 tokens (76 words) that overlap by 19 (14 words)."""
    w = documents(spark, sf_dir).select("doc_id", X.tokens("text", WORDS, Canonical()).alias("w"))
    return w.select("doc_id", F.posexplode(X.fixed_chunks("w", 100, 19)).alias("chunk", "c")).select("doc_id", "chunk", F.md5(F.col("c").cast("binary")).alias("digest"))


@query()
def chunk_sentence(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.chunks("text")).alias("chunk", "piece"))


@query()
def chunk_recursive(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.chunks("text", mode="recursive")).alias("chunk", "piece"))


# embeddings


def _embeddings(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", V.embedding("embedding", None, "null").alias("e")).filter("e IS NOT NULL")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT vec_id, len(e)::INTEGER AS dim, round(n::FLOAT::DOUBLE, 4) AS norm, round(sqrt(list_dot_product(u, u)), 4) AS unit_norm FROM (SELECT *, list_transform(e, lambda x: (x / n)::FLOAT::DOUBLE) AS u FROM n)")
def embedding_norms(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return e.select(F.col("id").alias("vec_id"), V.dim("e").alias("dim"), rounded(V.l2_norm("e")).alias("norm"), rounded(V.l2_norm(V.normalize("e"))).alias("unit_norm"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS probe, b.vec_id AS id, list_cosine_similarity(a.e, b.e)::FLOAT AS score FROM v a JOIN v b ON a.vec_id != b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rank FROM s) SELECT probe, id, round(score::DOUBLE, 4) + 0.0 AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def cosine_top5(spark, sf_dir):
    """The five nearest of every vector."""
    e = _embeddings(spark, sf_dir).select("id", "e")
    return corpus.cosine_neighbours(e, e, 5).select("probe", "id", rounded(F.col("score")).alias("score"), "rank")


@query("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, vec_id, e, first_value(e) OVER w AS f, first_value(vec_id) OVER w AS fid FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, fid AS first_id, round(list_dot_product(e, f)::FLOAT::DOUBLE, 3) + 0.0 AS dot FROM c")
def dot_with_first(spark, sf_dir):
    """The product of each vector with the first of its label."""
    e = _embeddings(spark, sf_dir)
    first = e.groupBy("label").agg(F.min_by(F.struct("id", "e"), "id").alias("f"))
    both = e.join(first, e.label.eqNullSafe(first.label))
    return both.select(F.col("id").alias("vec_id"), F.col("f.id").alias("first_id"), rounded(V.dot("e", "f.e", "null"), 3).alias("dot"))


@query("SELECT 'both named' AS pair, 'model mismatch: a vs b' AS error, count(*) AS n FROM embeddings UNION ALL SELECT 'one named', NULL, count(*) FROM embeddings UNION ALL SELECT 'shorter', 'dimension mismatch: ' || len(embedding) || ' vs ' || (len(embedding) - 1), count(*) FROM embeddings GROUP BY 2")
def embedding_guards(spark, sf_dir):
    """What comparison says of vectors of other models and lengths."""
    rows = _embeddings(spark, sf_dir)
    named = lambda m: F.struct(F.col("e.vector").alias("vector"), F.lit(m).cast("string").alias("model_id"))
    shorter = F.struct(F.slice("e.vector", 1, F.size("e.vector") - 1).alias("vector"), F.lit(None).cast("string").alias("model_id"))
    cases = [("both named", named("a"), named("b")), ("one named", named("a"), named(None)), ("shorter", F.col("e"), shorter)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), V.cosine(x, y)["error"].alias("error")) for k, x, y in cases])).alias("c")
    return rows.select(each).groupBy("c.pair", "c.error").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT label, d, avg(x) AS mean, max(x) AS top, min_by(x, vec_id) AS first FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, d), n AS (SELECT label, sqrt(sum(mean * mean)) AS a, sqrt(sum(top * top)) AS b, sqrt(sum(first * first)) AS c FROM p GROUP BY label) SELECT label, (d - 1)::INTEGER AS d, round(mean, 3) + 0.0 AS mean_no_norm, round(mean / a, 3) + 0.0 AS mean, round(top / b, 3) + 0.0 AS max, round(first / c, 3) + 0.0 AS cls FROM p JOIN n USING (label)")
def pooled_labels(spark, sf_dir):
    """The vectors of each label, in order, as a transformer's states, pooled in every way."""
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    g = g.select("label", F.flatten("r.embedding").alias("h"), F.size(F.col("r")[0]["embedding"]).alias("dim"))
    width = g.agg(F.max("dim")).first()[0] or 1
    p = g.select("label", *[V.pool("h", width, None, how).alias(how) for how in ("mean_no_norm", "mean", "max", "cls")])
    z = p.select("label", F.posexplode(F.arrays_zip("mean_no_norm", "mean", "max", "cls")).alias("d", "z"))
    return z.select("label", "d", *[rounded(F.col(f"z.{c}"), 3).alias(c) for c in ("mean_no_norm", "mean", "max", "cls")])


# the corpus as a whole

_GROUPS = f"c AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS copies FROM (SELECT doc_id, {q.canonical()} AS c FROM documents) WINDOW w AS (PARTITION BY c))"


@query(f"WITH {_GROUPS} SELECT * FROM c WHERE copies > 1")
def exact_duplicates(spark, sf_dir):
    return corpus.exact_groups(keyed(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(f"WITH {_GROUPS} SELECT doc_id, text FROM documents SEMI JOIN (SELECT * FROM c WHERE doc_id = keep_id) k USING (doc_id)")
def exact_dedup(spark, sf_dir):
    docs = keyed(spark, sf_dir)
    return corpus.keep_first(docs, corpus.exact_groups(docs)).withColumnRenamed("id", "doc_id")


@query(f"WITH {q.word_lists()}, {q.word_lists('benchmark', 'item_id', 'items')}, s AS (SELECT DISTINCT id, unnest({q.shingles('ws', 8)}) AS s FROM lists), i AS (SELECT DISTINCT id AS item_id, unnest({q.shingles('ws', 8)}) AS s FROM items) SELECT id AS doc_id, item_id, count(*) AS shared FROM s JOIN i USING (s) GROUP BY ALL")
def benchmark_contamination(spark, sf_dir):
    """Documents that share runs of eight words with benchmark items."""
    return corpus.contaminated(keyed(spark, sf_dir), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


# documents in chunks


@query(SQL["minhash_murmur"])
def chunked_minhash(spark, sf_dir):
    """Documents cut into pieces of bytes, put together again and sketched; the result is that of the whole texts."""
    pieces = chunked.cut(keyed(spark, sf_dir), 1000)
    m = chunked.minhash_of_chunks(pieces, WIDE).filter("sig IS NOT NULL")
    return m.select(F.col("id").alias("doc_id"), F.md5(F.array_join(F.transform("sig.hashes", S.hex64), "").cast("binary")).alias("digest"))


@query(SQL["simhash_tf"])
def chunked_simhash(spark, sf_dir):
    pieces = chunked.cut(keyed(spark, sf_dir), 777)
    m = chunked.simhash_of_chunks(pieces, SimHash(family=MURMUR3)).filter("sig IS NOT NULL")
    return m.select(F.col("id").alias("doc_id"), S.hex64(F.col("sig")).alias("simhash"))


@query("SELECT * FROM (VALUES (1, NULL), (2, 'invalid UTF-8 in stream'), (3, 'trailing incomplete UTF-8'), (4, 'empty document'), (5, 'stream exceeds 16 bytes')) v(id, error)")
def chunked_errors(spark, sf_dir):
    rows = [(1, 0, b"caf\xc3"), (1, 1, b"\xa9 ole"), (2, 0, b"abc \x80 def"), (3, 0, b"abc\xe2\x82"), (4, 0, b""), (5, 0, b"0123456789"), (5, 1, b"abcdefg")]
    out = chunked.minhash_of_chunks(spark.createDataFrame(rows, "id int, seq int, chunk binary"), MinHash(), max_bytes=16)
    return out.select("id", "error")
