import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def e():
    return bpe.encoder(bpe.vocabulary_path())


def same(e, text):
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    got = e.encode(text).tolist()
    assert got == want, text
    assert e.decode(got) == e.tokenizer.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_like_the_library(text):
    same(bpe.encoder(bpe.vocabulary_path()), text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdefghijxyzABC'sStlLrvemd 0123456789.,!#$%&|*<>éÉèñß\n\t\x1c\x85\xa0　\x7f\x00", max_size=60))
def test_like_the_library_on_words(text):
    same(bpe.encoder(bpe.vocabulary_path()), text)


def test_every_character_between_letters(e):
    for c in [*range(1, 0x3100), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)]:
        same(e, f"a{chr(c)}b")


def test_special_tokens_cuts_and_long_words(e):
    for t in ["<|endoftext|> x <|ENDOFTEXT|>", "a<|startoftext|><|endoftext|>b", "<|endoftext|", "x" * 5000, "zq" * 3000 + "###$$$" * 50, "", " \n "]:
        same(e, t)
    for word in ("qzjxqzzj", "hello", "###%%%&&&"):
        parts = e.cuts(word)
        assert "".join(parts) == word and all(a[-1] + b[0] not in e.pairs for a, b in zip(parts, parts[1:]))
    assert any(len(e.cuts(w)) > 1 for w in ("xqzjx", "vqkzx", "wzqxj"))


def test_documents(spark, e):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).select("text", "doc_id", "lang")
    df = df.unionByName(spark.createDataFrame([(None, -1, "x"), ("", -2, None)], "text string, doc_id long, lang string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = bpe.round_trip(df).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = e.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(e.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(df.filter("false")).count() == 0


def test_bounded_table():
    small = bpe.ForcedBoundaryEncoder(bpe.vocabulary_path(), cache_words=5)
    for t in ["a b c d e f g h i j", "k l m n o p a b c"]:
        same(small, t)
    assert len(small.pieces) <= 10 and len(small.words) <= 10
