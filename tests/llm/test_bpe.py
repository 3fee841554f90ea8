import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from tephra.llm import bpe

from .helpers import empty, frame

FILE = path("byte_bpe_multi_50k.tiktoken")
PARTS = st.one_of(
    st.text(max_size=20), st.sampled_from(["a", " ", "\n", "12", "é", "日", "$%", "\t", "'s", "the "]).flatmap(lambda p: st.integers(1, 700).map(lambda n: p * n)),
    st.sampled_from(["it's we'll ", "\n\n  x", " \n y", "a\nb", "1\n2", "\r\n", "  ", "😀", " x"]),
)


@settings(max_examples=80, deadline=None)
@given(st.lists(PARTS, max_size=10))
def test_ids_equal_the_library(parts):
    text = "".join(parts)
    codec = bpe.codec(FILE, PATTERN)
    ids = codec.encode(text)
    assert ids == codec.encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=10))
def test_cuts_change_nothing(parts):
    text = "".join(parts)
    codec, chunk = bpe.codec(FILE, PATTERN), bpe.CHUNK
    try:
        bpe.CHUNK = 7
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)
    finally:
        bpe.CHUNK = chunk


@pytest.mark.parametrize("piece", [b"aaaaaaaaaaaaa", b"abababababab", "日本語日本語".encode(), b"internationalization", bytes(range(256))])
def test_merging_equals_the_library(piece):
    codec = bpe.codec(FILE, PATTERN)
    assert codec.merge(piece) == codec.encoding._encode_single_piece(piece)


def test_very_long_match_is_fast():
    codec = bpe.codec(FILE, PATTERN)
    ids = codec.encode("ab" * 100_000)
    assert codec.decode(ids) == b"ab" * 100_000


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = bpe.encode(docs, FILE, PATTERN).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codec = bpe.codec(FILE, PATTERN)
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = codec.encoding.encode_ordinary(text) if len(text) < 20_000 or " " in text else codec.encode(text)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty(spark), FILE, PATTERN).count() == 0
