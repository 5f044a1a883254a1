import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.ByteBpe(f.read())


def ids(raw):
    return list(memoryview(raw).cast("I"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabcest'’é中12.!"))))
def test_any_text(text, own, library):
    raw = own.encode([text])[0]
    assert ids(raw) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(raw) == library.decode(ids(raw), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 20_000, " " * 5_000, "ab" * 9_000, "꟔ ²٣", "a'll 'LL 's\r\n\r\n  x"])
def test_odd_texts(text, own, library):
    raw = own.encode([text])[0]
    assert ids(raw) == library.encode(text, add_special_tokens=False).ids and own.decode(raw) == text


def test_every_token_stands_for_its_own_text(own):
    assert all(own.stands(t) for t in range(own.count))


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 2)
    with open(PATH, "rb") as f:
        tight = bpe.ByteBpe(f.read())
    texts = ["the quick brown fox", "jumps over the lazy dogs again", "the fox"]
    for _ in range(2):
        assert [ids(x) for x in tight.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_definitions_are_refused():
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
            bpe.ByteBpe(f.read())


def test_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for r in docs.collect():
        want = library.encode(r.text, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert got[r.doc_id].n_tokens == len(want) and got[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_decode_alone(spark):
    rows = spark.createDataFrame([(1, "é x"), (2, None)], "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(rows, PATH), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "é x", 2: ""}


def test_ids_outside_the_vocabulary_are_left_out(spark, own, library):
    known = library.encode("abc é", add_special_tokens=False).ids
    mixed = [4_000_000_000, *known, 3_999_999_999]
    raw = b"".join(n.to_bytes(4, "little") for n in mixed)
    assert own.decode(raw) == library.decode(mixed, skip_special_tokens=False) == "abc é"
