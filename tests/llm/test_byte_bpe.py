import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dialogprep.llm import byte_bpe, utf8
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF

RANKS = byte_bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
KNOWN = byte_bpe.Transducer(RANKS)
SPLITTER = byte_bpe.Splitter(public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def test_query_equals_the_library(spark, con):
    rows = {r.doc_id: r for r in QUERIES["op7_byte_bpe_roundtrip"](spark, SF).collect()}
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = OTHER.encode_ordinary(text)
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abthe ns'.0é\n", max_size=80))
def test_pieces_equal_the_library(text):
    ids = np.frombuffer(byte_bpe.encoded(SPLITTER, KNOWN, text), "<u4")
    assert ids.tolist() == OTHER.encode_ordinary(text)


def test_transitions_without_room(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", 5)
    small = byte_bpe.Transducer(RANKS)
    for word in ("internationalisation", "x" * 300, "étéàüß" * 20):
        ids = np.frombuffer(small.encode_piece(word.encode()), "<u4").tolist()
        assert ids == OTHER.encode_ordinary(word)


@given(st.binary(max_size=24), st.integers(1, 5))
def test_state_machine_equals_a_whole_decode(data, step):
    out, pending = "", b""
    for i in range(0, len(data), step):
        text, pending = utf8.feed(pending, data[i:i + step])
        out += text
    assert out + utf8.close(pending) == data.decode(errors="replace")


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "the cat", "c"), (3, "the cat", "c"), (None, "x", None)],
        "doc_id long, text string, ids string",
    )
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [
        (0, 1, "x"), (1, 0, ""), (2, 0, ""), (3, 2, "the cat"), (3, 2, "the cat")]
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "the cat " * 50_000])
def test_long_texts(text):
    ids = np.frombuffer(byte_bpe.encoded(SPLITTER, KNOWN, text), "<u4")
    assert ids.tolist() == OTHER.encode_ordinary(text)


def test_white_space_and_letters_as_in_the_library():
    for start in range(0, 0x3100, 64):
        text = "".join(f"a{chr(c)}b 1{chr(c)} " for c in range(start, start + 64))
        ids = np.frombuffer(byte_bpe.encoded(SPLITTER, KNOWN, text), "<u4")
        assert ids.tolist() == OTHER.encode_ordinary(text), hex(start)


def test_latin_texts_have_a_pattern_of_their_own():
    assert type(SPLITTER.latin).__module__ == "re"


def test_a_frequent_match_is_encoded_once(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_REMEMBERED", 6)
    small, made = byte_bpe.Transducer(RANKS), []
    encode = small.encode_piece
    monkeypatch.setattr(small, "encode_piece", lambda piece: made.append(piece) or encode(piece))
    for letter in "abcdefghijklmnopqrst":
        ids = small.ids_of(["often", f" {letter}rare"])
        assert np.frombuffer(ids, "<u4").tolist() == OTHER.encode_ordinary(f"often {letter}rare")
    assert made.count(b"often") == 1 and len(made) == 21


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abtheionsrgé漢", min_size=1, max_size=700), max_size=9))
def test_places_without_room(words):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(byte_bpe, "MAX_TRANSITIONS", 3)
        patch.setattr(byte_bpe, "MAX_STEPS", 50)
        small = byte_bpe.Transducer(RANKS)
        for word in words:
            ids = np.frombuffer(small.encode_piece(word.encode()), "<u4").tolist()
            assert ids == OTHER._encode_single_piece(word.encode())
