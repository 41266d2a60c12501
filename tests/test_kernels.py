import math
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.config import GRAPHEMES, MURMUR3, SEED, WORDS, XXH3, Canonical, MinHash, SimHash, Tokens, config_hash, config_hash_of
from loomtext.errors import ConfigError, InvalidInput
from loomtext.kernels import canon, chunk, html, markdown, pdf, pooling, sketch, tlsh
from loomtext.kernels.hashing import hash128, murmur3
from loomtext.kernels.words import _ASCII, _WORD, graphemes, sentences, shingles, tokenizer, words

U = np.uint64
texts = st.text(max_size=80)


# canonical form


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Hello WORLD", "hello world"),
        ("﻿a​b‍c", "abc"),
        ("Straße", "strasse"),
        ("İ", "i̇"),
        ("ﬁne ① ｆｕｌｌ", "fine 1 full"),
        ("a‮b⁦c", "abc"),
        ("x\U000e0041️y", "xy"),
        ("a­b", "a­b"),
        ("line\r\n\ttab ", "line\r\n\ttab "),
        ("Å", "å"),
    ],
)
def test_canonical(raw, want):
    assert canon.canonical(raw) == want


@settings(max_examples=300, deadline=None)
@given(texts)
def test_canonical_is_idempotent_and_clean(t):
    once = canon.canonical(t)
    assert canon.canonical(once) == once
    assert not canon._FORMAT.search(once) and len(once) <= 18 * max(1, len(t))


@pytest.mark.parametrize("t", ["İ̩", "ۤ‪۪ۤ-\x02\x03", "e" + "́" * 10_000])
def test_canonical_of_known_trouble(t):
    once = canon.canonical(t)
    assert canon.canonical(once) == once


def test_canonical_settings():
    t = "A‮​ﬁ"
    assert canon.canonical(t, Canonical("none", False, False, False)) == t
    assert canon.canonical(t, Canonical("none", False, True, False)) == "A​ﬁ"
    assert canon.canonical(t, Canonical("nfc", False)) == "Aﬁ"
    assert canon.canonical("раураl", Canonical(confusable=True), {0x440: "p", 0x430: "a", 0x443: "y"}) == "paypal"
    assert Canonical().name() == "nfkc-cf-simple-bidi-fmt"
    assert Canonical("none", False, False, False, True).name() == "none-cf-none-conf"
    with pytest.raises(ConfigError):
        Canonical("nfd")


# tokens


def test_words():
    assert words("don't v1.2 3.14 can’t foo:bar a_b e-mail") == ["don't", "v1.2", "3.14", "can’t", "foo:bar", "a_b", "e", "mail"]
    assert words("漢字 カタカナ 한국어") == ["漢", "字", "カタカナ", "한국어"]
    assert words("l'été d'un 'ami") == ["l'été", "d'un", "ami"] and words("é 12,5 x.y_z") == ["é", "12,5", "x.y_z"]
    assert words("__ ... !") == [] and words("") == []


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ09_.,:;' -\n\r\"", max_size=40))
def test_ascii_words_follow_the_general_rules(t):
    general = [w for w in _WORD.findall(t) if re.search("[a-zA-Z0-9]", w)]
    assert [w for w in _ASCII.findall(t) if w.strip("_")] == general


def test_graphemes():
    assert graphemes("éa 👨‍👩‍👧🇩🇪") == ["é", "a", " ", "👨‍👩‍👧", "🇩🇪"]
    assert graphemes("a\r\nb") == ["a", "\r\n", "b"]


def test_shingles():
    assert shingles(list("abcd"), 2) == ["a b", "b c", "c d"]
    assert shingles(["a"], 3) == ["a"] and shingles([], 3) == [] and shingles(["a"], 0) == []
    assert tokenizer(Tokens(shingle=(2, 2)))("a b c") == ["a b b c"]
    assert Tokens(shingle=(5,)).name() == "shingle-k=5/word-uax29" and GRAPHEMES.name() == "grapheme-uax29"
    assert WORDS.shingled(2).shingled(3).name() == "shingle-k=3/shingle-k=2/word-uax29"
    assert Tokens("cjk-jieba", hmm=True).name() == "cjk-jieba-hmm"


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(0, 6))
def test_tokens_as_bytes(t, k):
    own = Tokens(shingle=(k,))
    assert sketch.tokens_of(t, own) == [x.encode("utf-8", "surrogatepass") for x in tokenizer(own)(t)]


def test_sentences():
    assert sentences("Hello there. Dr. who? It cost 3.5 today! and U.S. law...") == ["Hello there.", "Dr. who?", "It cost 3.5 today!", "and U.S. law..."]
    assert sentences("One.\nTwo\n\nThree") == ["One.", "Two", "Three"]
    assert sentences("日本語。次の文。") == ["日本語。", "次の文。"]
    assert sentences("") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1. ?!,\ń‍)(", max_size=40))
def test_sentences_lose_nothing(t):
    squeeze = lambda s: re.sub(r"\s", "", s)
    assert squeeze("".join(sentences(t))) == squeeze(t)


# hashes and sketches


def test_public_vectors():
    lo, hi = murmur3([b"hello"], 0)
    assert (int(lo[0]), int(hi[0])) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    keys = [b"", b"a", b"x" * 15, b"y" * 16, b"z" * 100]
    lo, hi = hash128(keys, XXH3, SEED)
    for k, a, b in zip(keys, lo, hi):
        assert int(b) << 64 | int(a) == xxhash.xxh3_128_intdigest(k, SEED)
    one = [hash128([k], MURMUR3, SEED) for k in keys]
    lo, hi = hash128(keys, MURMUR3, SEED)
    assert [int(x) for x in lo] == [int(o[0][0]) for o in one] and [int(x) for x in hi] == [int(o[1][0]) for o in one]


@settings(max_examples=50, deadline=None)
@given(st.lists(texts, max_size=6), st.sampled_from([XXH3, MURMUR3]), st.integers(1, 40))
def test_minhash_is_its_definition(docs, family, slots):
    config = MinHash(slots, Tokens(shingle=(2,)), family=family)
    found, some = sketch.minhash(docs, config)
    for t, row, ok in zip(docs, found, some):
        own = tokenizer(config.tokens)(canon.canonical(t))
        lo, hi = hash128([x.encode("utf-8", "surrogatepass") for x in own], family, config.seed)
        want = [min((int(a) + i * int(b)) % 2**64 for a, b in zip(lo, hi)) for i in range(slots)] if own else [2**64 - 1] * slots
        assert row.tolist() == want and ok == bool(own)


def test_minhash_of_long_texts(monkeypatch):
    docs = ["w%d and so on " % i * 50 for i in range(9)] + [" ".join(f"t{i}" for i in range(3000)), "", "short"]
    want, _ = sketch.minhash(docs, MinHash())
    monkeypatch.setattr(sketch, "_BLOCK", 100)
    got, _ = sketch.minhash(docs, MinHash())
    assert (want == got).all()
    assert (sketch.simhash(docs, SimHash())[0] == np.array([sketch.simhash([d], SimHash())[0][0] for d in docs])).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=30), max_size=5), st.sampled_from(["tf", "uniform", "idf"]))
def test_simhash_is_its_definition(docs, weighting):
    idf = {"a": 0.3, "b": 2.5, "ab": float("inf"), "bb": -1.0}
    config = SimHash(weighting=weighting)
    found, some = sketch.simhash(docs, config, idf)
    for t, bits, ok in zip(docs, found, some):
        own = words(canon.canonical(t))
        lanes = [0] * 64
        for w in set(own):
            tf = own.count(w)
            x = np.float32(tf) * np.float32(idf.get(w, 1.0))
            weight = {"tf": tf, "uniform": 1, "idf": int(np.trunc(np.clip(float(x), -1e15, 1e15))) if np.isfinite(x) else 1}[weighting]
            h = int(hash128([w.encode()], XXH3, config.seed)[0][0])
            for b in range(64):
                lanes[b] += weight if h >> b & 1 else -weight
        assert int(bits) == sum(1 << b for b in range(64) if lanes[b] > 0) and ok == bool(own)


def test_a_low_idf_adds_nothing_before_it_makes_one():
    assert sketch.simhash(["rare"], SimHash(weighting="idf"), {"rare": 0.1})[0][0] == 0
    assert sketch.simhash(["rare " * 10], SimHash(weighting="idf"), {"rare": 0.1})[0][0] != 0


def test_names_and_hashes():
    assert MinHash().algorithm() == "minhash-h128" and MinHash(64).algorithm() == "minhash"
    named = f"nfkc-cf-simple-bidi-fmt|shingle-k=5/word-uax29|minhash-h128|xxh3-64|seed:{SEED:016x}"
    assert config_hash_of(MinHash()) % 2**64 == xxhash.xxh3_64_intdigest(named.encode())
    assert config_hash("a", "b", "c") % 2**64 == xxhash.xxh3_64_intdigest(b"a|b|c")
    for bad in (dict(slots=0), dict(family="md5"), dict(seed=-1)):
        with pytest.raises(ConfigError):
            MinHash(**bad)


# tlsh


ALPHA = "The quick brown fox jumps over the lazy dog while seventeen clerks counted their ledgers in the cold northern light of the harbour office. "
BETA = "Zinc oxide lattices, when annealed above nine hundred kelvin, display anomalous photoluminescence that no present theory of defects explains! "


def test_tlsh():
    a, edited, b = tlsh.digest(ALPHA.encode()), tlsh.digest(ALPHA.replace("lazy", "idle").encode()), tlsh.digest(BETA.encode())
    assert len(a) == 72 and a.startswith("T1") and tlsh.distance(a, a) == 0
    assert tlsh.distance(a, edited) == tlsh.distance(edited, a) < tlsh.distance(a, b)
    for bad in (b"short", b"a" * 300):
        with pytest.raises(InvalidInput):
            tlsh.digest(bad)
    for bad in ("T1zz", "", a[:-2]):
        with pytest.raises(InvalidInput):
            tlsh.distance(a, bad)
    assert sorted(tlsh.TABLE.tolist()) == list(range(256))


def test_tlsh_buckets_against_a_loop():
    data = (ALPHA + BETA).encode()

    def pearson(*xs):
        h = 0
        for x in xs:
            h = int(tlsh.TABLE[h ^ x])
        return h

    counts, check = [0] * 256, 0
    for i in range(4, len(data)):
        w = [data[i - j] for j in range(5)]
        check = pearson(0, w[0], w[1], check)
        for salt, x, y, z in tlsh.TRIPLETS:
            counts[pearson(salt, w[x], w[y], w[z])] += 1
    q = sorted(counts[:128])
    code = [sum((sum(counts[4 * i + j] > q[k] for k in (31, 63, 95))) << 2 * j for j in range(4)) for i in range(32)]
    got = bytes.fromhex(tlsh.digest(data)[2:])
    assert list(got[3:]) == code[::-1] and (got[0] & 15) << 4 | got[0] >> 4 == check


# chunks and pooling


def test_chunks():
    assert chunk.approx_tokens(10) == 13 and chunk.approx_tokens(0) == 0
    assert chunk.fixed("a b c d e f g h i j", 4, 2) == ["a b c", "c d e", "e f g", "g h i", "i j"]
    assert chunk.fixed("a b", 100, 10) == ["a b"] and chunk.fixed("", 4, 1) == []
    assert chunk.fixed("a b c", 1, 50) == ["a", "b", "c"]
    t = "One two three. Four five six. Seven eight nine. " + "X " * 30 + "."
    got = chunk.chunks(t, 9, 2, "sentence")
    assert got[0] == "One two three. Four five six." and got[1] == "six Seven eight nine." and got[2].startswith("X X")
    assert chunk.chunks("a b.\n\n\n\nc d.\n\n" + "Long one here. " * 9, 8, 0, "recursive")[0] == "a b.\n\nc d."
    assert chunk.chunks("text", 0) == [] and chunk.chunks("", 10) == []
    with pytest.raises(ConfigError):
        chunk.chunks("x", 1, 1, "none")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.integers(1, 40), st.integers(0, 50))
def test_fixed_windows_against_a_loop(n, most, overlap):
    own = [f"w{i}" for i in range(n)]
    width = max(1, int(np.floor(np.float32(most) / np.float32(1.3))))
    step = width - min(int(np.floor(np.float32(overlap) / np.float32(1.3))), width - 1)
    want, i = [], 0
    while i < n:
        want.append(" ".join(own[i : i + width]))
        if i + width >= n:
            break
        i += step
    assert chunk.fixed(" ".join(own), most, overlap) == want


def test_pooling():
    h = np.array([3, 4, 0, 0, 6, 8], np.float32)
    assert np.allclose(pooling.pool(h, 2, None, "cls"), [0.6, 0.8])
    assert np.allclose(pooling.pool(h, 2, None, "mean_no_norm"), [3, 4])
    assert np.allclose(pooling.pool(h, 2, np.array([1, 0, 1]), "mean_no_norm"), [4.5, 6])
    assert np.allclose(pooling.pool(h, 2, np.array([0, 1]), "max"), [0, 0])
    assert np.allclose(pooling.pool(h, 2, None, "max"), [0.6, 0.8])
    assert np.allclose(pooling.pool(h, 2, np.zeros(3), "mean"), [0, 0])
    assert len(pooling.pool(h[:0], 2)) == 0 and len(pooling.pool(h, 0)) == 0


# extraction


def test_html():
    page = "<html><head><title>T &amp; t</title><style>p {x}</style></head><body><h1>Head</h1><p>One <b>two</b>\n three<SCRIPT>bad()</SCRIPT></p><ul><li>a<li>b</ul>caf&eacute;<script>unclosed"
    got = html.text(page)
    assert "bad" not in got and "p {x}" not in got and "unclosed" not in got
    assert all(x in got for x in ("T & t", "Head", "One two three", "* a", "* b", "café"))
    assert html.visible("a<scripture>b</script>c") == "ac" and html.text("") == ""
    assert html.text("<p>unclosed <i>tags") == "unclosed tags"


@pytest.mark.parametrize(
    "source, want",
    [
        ("# Title\n\nA *bold* __move__.", "Title A bold move."),
        ("Head\n----\ntext", "Head text"),
        ("a [link](http://x \"t\") ![alt](i.png) <b>raw</b> <http://auto.x>", "a link alt raw http://auto.x"),
        ("- one\n- two\n  more\n\n1. x", "one two more x"),
        ("> quoted\nlazy", "quoted lazy"),
        ("a  \nb\\\nc", "a b c"),
        ("`code` &amp; \\*not\\*", "code & *not*"),
        ("[ref][r] and [r]\n\n[r]: http://x", "ref and r"),
        ("| a | b |\n~~s~~", "| a | b | ~~s~~"),
        ("snake_case_word **open", "snake_case_word **open"),
        ("<div>\nraw\n</div>\n\nafter", "after"),
        ("***\n\nx", "x"),
        ("", ""),
    ],
)
def test_markdown(source, want):
    assert markdown.text(source) == want


def test_markdown_options():
    t = "a `b`\n\n```rust\nfn x() {}\n```\n\n    indented\n\nend"
    assert "fn x() {}" in markdown.text(t) and "indented" in markdown.text(t)
    bare = markdown.text(t, markdown.Options(code_blocks=False, inline_code=False))
    assert "fn" not in bare and "indented" not in bare and bare.split() == ["a", "end"]
    assert markdown.text("a\n\nb", markdown.Options(break_to_space=False)) == "ab"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*_`[]()<>!#- \n>1.&\\~=:\t", max_size=60))
def test_markdown_takes_anything(t):
    assert markdown.text(t) == markdown.text(t).strip()


def test_pdf():
    import zlib

    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(x\\)\\041) Tj T* [(Wor) -20 (ld) -300 (again)] TJ <0041> Tj ET")
    cmap = b"1 beginbfchar <0041> <20AC> endbfchar"
    file = b"%PDF-1.7\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n2 0 obj\n<< /Nothing true >>\nendobj\n"
    assert pdf.text(file).split("\n")[:2] == ["Hello (x)!", "World again\0A".replace("\0", "�")]
    mapped = b"%PDF-1.7\n1 0 obj\n<< >>\nstream\nBT /F2 9 Tf <00410041> Tj ET\nendstream\nendobj\n3 0 obj\n<< /ToUnicode 4 0 R >>\nendobj\n4 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n5 0 obj\n<< /Font << /F2 3 0 R >> >>\nendobj\n"
    assert pdf.text(mapped) == "€€"
    for bad, options in ((b"", pdf.Options()), (b"not a pdf", pdf.Options()), (file, pdf.Options(max_bytes=10)), (file, pdf.Options(timeout_secs=-1)), (b"%PDF-1.4 nothing", pdf.Options())):
        with pytest.raises(InvalidInput):
            pdf.text(bad, options)


def test_scripts_differ():
    docs = ["The quick brown fox", "敏捷的棕色狐狸跳过了懒狗", "素早い茶色の狐", "빠른 갈색 여우", "Быстрая лиса", "الثعلب البني السريع", "השועל החום", "तेज़ भूरी लोमड़ी", "สุนัขจิ้งจอก", "γρήγορη αλεπού", "నక్క వేగంగా", "Çabuk tilki"]
    found, some = sketch.minhash(docs, MinHash(tokens=WORDS))
    assert some.all() and len({tuple(f) for f in found}) == len(docs)
    assert math.isclose(len(unicodedata.normalize("NFC", docs[0])), len(docs[0]))


def test_pdf_stream_beyond_the_limit():
    """No prefix of a text without an error."""
    import zlib

    stream = zlib.compress(b"BT (begin) Tj ET" + b" " * 5000 + b"BT (end) Tj ET")
    file = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    assert pdf.text(file, pdf.Options(max_bytes=5030)) == "begin\nend"
    with pytest.raises(InvalidInput):
        pdf.text(file, pdf.Options(max_bytes=5029))
