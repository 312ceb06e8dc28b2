import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dialogprep.llm import token_files
from dialogprep.llm.huffman import Code, code_lengths
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)
OWN = token_files.WordTokenizer(DEFINITION)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, con):
    rows = QUERIES["op9_token_files"](spark, SF).orderBy("doc_id").collect()
    start = 0
    texts = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    assert [r.doc_id for r in rows] == [d for d, _ in texts]
    for row, (_, text) in zip(rows, texts):
        ids = np.array([*library_ids(text), 2], "<u4")
        assert tuple(row)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=50) | st.text(alphabet="aB'sé́ͅİς \n \x1c<|endoftext|>9", max_size=60)
       | st.text(alphabet=[chr(i) for i in range(256)], max_size=60)
       | st.text(alphabet="aBstÉmdreµª²'\x85\xa0 .", max_size=40))
def test_parts_equal_whole_texts(text):
    assert np.frombuffer(OWN.encode([text.encode()])[0], "<u4").tolist() == library_ids(text)
    two = OWN.encode([text.encode(), b"a"])
    assert np.frombuffer(two[0], "<u4").tolist() == library_ids(text)


def test_latin_texts_take_the_smaller_parts():
    assert OWN.latin is not None
    assert list(OWN._parts("Don't été,12".encode())) == [["don", "'t", "été", ",", "1", "2"]]
    other = token_files.WordTokenizer(DEFINITION.replace("NFC", "NFD"))
    assert other.latin is None and list(other._parts(b"a b,")) == [[b"a", b"b,"]]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 20))
def test_code_is_complete_and_limited(counts, limit):
    counts = np.array(counts)
    lengths = code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0 ** -used) == 1


def test_code_length_equals_huffman_without_a_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 10_000, 200)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        total += joined
        heapq.heappush(heap, joined)
    assert int((counts * code_lengths(counts, 30)).sum()) == total


@given(st.lists(st.integers(0, 40), max_size=700), st.integers(1, 40))
def test_bits_roundtrip(symbols, every):
    symbols = np.array(symbols, np.uint32)
    code = Code(code_lengths(2 ** (np.arange(41) // 3) + np.bincount(symbols, minlength=41), 9))
    bits, offsets = code.encode(symbols, every)
    assert code.decode(bits, offsets, len(symbols), every).tolist() == symbols.tolist()


def test_blocks_stand_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 8)
    docs = spark.createDataFrame(
        [(3, "the cat sat on the mat " * 30, 0), (1, None, 1), (2, "", 2), (None, "x", 3), (5, "a b", 4),
         (5, "a b", 4), (4, "ünïcode 12", 5)], "doc_id long, text string, ids int")
    path = str(tmp_path / "set")
    token_files.write(docs, path, DEFINITION, 2, shards=2)
    rows = token_files.read(spark, path).orderBy("start", "n_tokens").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5]
    assert [r.n_tokens for r in rows] == [2, 1, 1, 181, len(library_ids("ünïcode 12")) + 1, 3, 3]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert ids[4:10].tolist() == library_ids("the cat sat on the mat")
    # one block, from its second checkpoint on
    block = spark.read.parquet(path + "/blocks").where("n_ids > 256 or n_ids = 181").collect()[0]
    assert sum(block.lengths) == block.n_ids


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(docs, str(tmp_path / "none"), DEFINITION, 2, shards=2)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_symbol_without_code():
    with pytest.raises(ValueError):
        Code(code_lengths(np.array([3, 0, 1]), 8)).encode(np.array([1]), 4)


def test_the_library_prepares_no_latin_text(monkeypatch):
    own = token_files.WordTokenizer(DEFINITION)
    monkeypatch.setattr(own, "_learn", lambda new: pytest.fail("a Latin text was prepared anew"))
    texts = ["Été ÀÇ ªº ²½ ÿ's you'RE 'tis '' 'll", "\x00\x1c\x7f\x85\xa0\xad a\x1cb 12,5", "x" * 300 + " y"]
    texts.append("".join(map(chr, range(256))))
    got = own.encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_remembered_parts_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_REMEMBERED", 3)
    own = token_files.WordTokenizer(DEFINITION, "<u2")
    text = "one two three four five one " + "long" * 40
    assert np.frombuffer(own.encode([text.encode()])[0], "<u2").tolist() == LIBRARY.encode(
        text, add_special_tokens=False).ids
    assert len(own.parts) <= 3


def test_a_frequent_part_is_asked_for_once(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_REMEMBERED", 6)
    own, asked = token_files.WordTokenizer(DEFINITION), []
    make = own.parts._make
    monkeypatch.setattr(own.parts, "_make", lambda part: asked.append(part) or make(part))
    for i in range(20):
        own.encode([f"often {'abcdefghijklmnopqrst'[i]}rare".encode()])
    assert asked.count("often") == 1 and len(asked) == 21


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=[chr(i) for i in range(256)], max_size=30)
                | st.text(alphabet="'stredvmlé.1 \x1c\x85", max_size=30), max_size=5))
def test_array_cuts_equal_the_pattern(texts):
    lowered = [t.lower() for t in texts]
    parts, which, cuts = OWN.cutter.cut([t.encode("latin-1") for t in lowered])
    got = [[parts[i] for i in which[a:b]] for a, b in zip(cuts, cuts[1:])]
    assert got == [OWN.latin.findall(t) for t in lowered]
