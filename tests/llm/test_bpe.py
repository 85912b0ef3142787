"""The encoder against the tokenizers library, and exact round trips."""
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incipit.llm.bpe import ByteBPE, default_vocabulary, encode_documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return ByteBPE(open(default_vocabulary(), encoding="utf-8").read()), tokenizers.Tokenizer.from_file(default_vocabulary())


CASES = ["", " ", "a", "Hello world", "a  b   c\n\n  d", "it's I'll we'VE", "<|endoftext|>x<|endoftext|>", "é  ß ñ　", "𝔘𝔫𝔦 日本語 ١٢٣ ½", "\x1c\x1d \x85 x", "a" * 5000, " " * 3000, "\x00퟿\U0010ffff", "ab\r\n\tcd"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids(both, text):
    own, lib = both
    ids = own.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_random_texts(both, text):
    own, lib = both
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_frame(spark, both):
    own, lib = both
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (None, "x"), (3, "")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, encode_documents(docs, default_vocabulary()).collect()), key=str)
    want = []
    for a, b in rows:
        ids = lib.encode(b or "", add_special_tokens=False).ids
        want.append((a, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((b or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(docs.limit(0), default_vocabulary()).count() == 0


def test_refuses_what_it_does_not_follow():
    import json

    j = json.loads(open(default_vocabulary(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": j["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": j["model"] | {"ignore_merges": True}}, {"added_tokens": [j["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            ByteBPE(json.dumps(j | change))
