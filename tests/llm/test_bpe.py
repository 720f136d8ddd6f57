import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inquest.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.ForcedBoundaryBpe(PATH), Tokenizer.from_file(PATH)


def same(text):
    ids = np.frombuffer(OURS.encode(text), "<u4").tolist()
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert OURS.decode(OURS.encode(text)) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b  ", "x" * 5000, "日本語 \U0001f600", "a՘b", "\n\n \t x\r\n", "it's 12３٣ I'll", "aaaa" * 1000 + "é" * 500, "\x1c \x85\xa0  x", "Ᲊᲊ new"])
def test_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


def test_fragments_concatenate_to_the_piece_and_are_cut_at_unknown_pairs():
    piece = " Straße123xqz".encode()
    parts = OURS.fragments(piece)
    assert b"".join(parts) == piece
    for a, b in zip(parts, parts[1:], strict=False):
        assert not any(a[-1:] + b[:1] in token for token in OURS.tokens[:50256])


def test_long_fragments_merge_as_short_ones():
    for word in ("thethethe", "aaaaaaaab", "informational"):
        assert OURS._merge(word.encode()) == OURS._merge_long(word.encode())


def test_query(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (1, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens): r for r in bpe.digests(docs).collect()}
    ids = np.array(THEIRS.encode("hello world", add_special_tokens=False).ids, "<u4")
    assert out[1, len(ids)].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    assert out[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest() == out[3, 0].ids_sha256
    assert bpe.digests(docs).count() == 4
    assert bpe.digests(docs.limit(0)).count() == 0


def test_encode_and_decode_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "été à la plage", "k")], "doc_id long, text string, note string")
    row = bpe.decode(bpe.encode(docs, PATH), PATH).collect()[0]
    assert (row.note, row.decoded) == ("k", "été à la plage")
