import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corroborate.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(bpe.tokenizer(PATH).encode(text), "<u4").tolist()


ODD = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  \n\n x\t\ty  ", "I'LL don't we've 'S's", "١٢٣ ½ Ⅷ", "👩‍👩‍👧 é é", "a" * 5000, "ab" * 3000 + " " * 500, "\x00\x01\x7f\x85\xa0", "漢字かな交じり文", "x\r\ny"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="abcdeinotrs  \n\t'’.,!?0123456789éüßñ中文字日本ไทย🙂ÀЯжअ", max_size=80))
def test_same_ids_as_the_library_and_back(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.tokenizer(PATH).decode(np.array(want, "<u4").tobytes()) == LIBRARY.decode(want, skip_special_tokens=False)


def test_batches_and_a_small_cache_change_nothing(monkeypatch):
    texts = [f"word{i} {i * 7919} some thing" for i in range(200)]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    own = bpe.ByteBpe(open(PATH, "rb").read())
    assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in own.encode_batch(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_broken_utf8_is_replaced():
    one = bpe.tokenizer(PATH).encode("é")
    first = LIBRARY.encode("é", add_special_tokens=False).ids
    cut = np.array(LIBRARY.encode("🙂", add_special_tokens=False).ids[:1], "<u4")
    assert len(one) == 4 * len(first)
    assert bpe.tokenizer(PATH).decode(cut.tobytes()) == LIBRARY.decode(cut.tolist(), skip_special_tokens=False)


def test_columns(spark, documents):
    d = documents([(1, None), (2, "hello world"), (2, "hello world"), (3, "y" * 100_000)])
    rows = d.select("doc_id", bpe.digests(spark)(d.text).alias("x"), bpe.decoder(spark)(bpe.encoder(spark)(d.text)).alias("back"), "text").collect()
    assert all(r.x.exact and r.back == (r.text or "") for r in rows)
    assert [r.x.n_tokens for r in rows if r.text is None] == [0]
    assert documents([]).select(bpe.digests(spark)("text")).count() == 0


def test_pairs_read_off_the_rules_are_what_merging_them_gives():
    own = bpe.tokenizer(PATH)
    rng = np.random.default_rng(3)
    short = np.array([i for t, i in own.ids.items() if len(t) < 5])
    a, b = rng.choice(short, 20_000), rng.choice(short, 20_000)
    got = own.compatible(a << 32 | b)
    want = [own.merge(own.tokens[x] + own.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    runs = np.array([i for t, i in own.ids.items() if len(set(t)) == 1])
    a, b = (x.ravel() for x in np.meshgrid(runs, runs))
    assert own.compatible(a << 32 | b).tolist() == [own.merge(own.tokens[x] + own.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_merging_many_is_merging_each():
    own = bpe.tokenizer(PATH)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 103, rng.integers(1, 60)).astype(np.uint8)) for _ in range(3000)] + [b"a", b"aaaaaaaa", b"\x00\xff"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge_many(words)] == [own.merge(w) for w in words]


def test_a_vocabulary_whose_rules_are_out_of_order_is_merged_exactly():
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    own, library = bpe.ByteBpe(json.dumps(spec).encode()), tokenizers.Tokenizer.from_str(json.dumps(spec))
    assert not own.layered
    for t in ("hello world, these are words", "aaaa bbbb abab"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    own = bpe.ByteBpe(open(PATH, "rb").read())
    texts = ["don't stop  now \n it's 12 3 a  b<|endoftext|> x 🙂 ünd " * 40, "y" * 3000, "short"]
    pieces = [list(own.pieces(t)) for t in texts]
    assert ["".join(p) for p in pieces] == texts and len(pieces[0]) > 40
    for t, x in zip(texts, own.encode_batch(texts), strict=True):
        held = list(x)
        assert np.frombuffer(b"".join(held), "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
        assert "".join(own.decode_pieces(held)) == t


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.characters(max_codepoint=255), max_size=60))
def test_latin_words_are_the_words(text):
    assert bpe.words_of(text) == bpe.WORDS.findall(text)


def test_every_word_of_at_most_64_bytes_is_proposed_and_tested(monkeypatch):
    """Long words go the same way as short ones: none of them is merged on its own, and the ids are the library's."""
    words = ["internationalisation", "counterrevolutionaries", "d41d8cd98f00b204e9800998ecf8427e", "x" * 64, "é" * 32, "漢字" * 10, "=" * 40, "Donaudampfschifffahrtsgesellschaft", "ab" * 31]
    assert all(16 < len(w.encode()) <= 64 for w in words)
    own = bpe.ByteBpe(open(PATH, "rb").read())
    monkeypatch.setattr(own, "merge", lambda w: pytest.fail(f"{w} was merged on its own"))
    got = [np.frombuffer(b"".join(x), "<u4").tolist() for x in own.encode_batch(words)]
    assert got == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    assert own.failed < sum(len(bpe.words_of(w)) for w in words)
