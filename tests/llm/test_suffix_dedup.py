import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialogprep.llm import suffix_dedup
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of texts in the order of their ids."""
    seen, out = set(), []
    for text in texts:
        covered = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - length + 1):
            window = text[at:at + length]
            if window in seen:
                covered[at:at + length] = True
            seen.add(window)
        covered[len(text)] = False
        spans = int((covered[1:] < covered[:-1]).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~covered[:-1]]) if text else b""
        out.append((len(text), int(covered.sum()), spans, kept))
    return out


def test_query_equals_brute_force(spark, con):
    rows = QUERIES["op5_suffix_dedup"](spark, SF).orderBy("doc_id").collect()
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    want = brute([(t or "").encode() for _, t in docs], 100)
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    assert sum(n > 0 for _, n, _, _ in want) > 5
    for row, (size, removed, spans, kept) in zip(rows, want):
        assert tuple(row)[1:] == (size, removed, spans, hashlib.sha256(kept).hexdigest())


def run(spark, rows, length, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    out = suffix_dedup.dedup(docs, length, **more).collect()
    return {r.rest.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}, out


@pytest.mark.parametrize("hot,chunk", [(20_000, 1 << 20), (0, 64), (2, 40)])
def test_equals_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "ZONES_AT_ONCE", 50)
    rng = np.random.default_rng(hot)
    base = ["".join(rng.choice(list("abé"), 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [base[i] for i in rng.integers(0, 6, rng.integers(0, 4))]
        text = "".join(parts)[int(rng.integers(0, 30)):]
        if text and rng.random() < 0.5:
            at = int(rng.integers(0, len(text)))
            text = text[:at] + "x" + text[at + 1:]
        texts.append(text)
    texts += ["a" * 90, "ab" * 50, "a" * 30, ""]
    for length in (12, 25):
        got, _ = run(spark, [(i, t, 0) for i, t in enumerate(texts)], length)
        want = brute([t.encode() for t in texts], length)
        assert [got[i] for i in range(len(texts))] == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=120), st.integers(3, 40))
def test_pointers_tell_equal_strings(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    pointer = suffix_dedup.refine(data, length)
    windows = range(len(text) - length + 1)
    assert all((pointer[i] == pointer[j]) == (text[i:i + length] == text[j:j + length])
               for i in windows for j in windows)


def test_whole_characters_stay(spark):
    text = "é" * 10 + "xy" + "é" * 10
    got, _ = run(spark, [(1, text, 0), (2, "a" + text + "b", 0)], 9, characters=True)
    assert all(kept.decode() is not None for _, _, _, kept in got.values())


def test_edges(spark):
    passage = "".join(np.random.default_rng(7).choice(list("abcdef "), 150))
    rows = [(None, passage, 0), (1, None, 0), (2, "", 0), (3, passage, 0), (3, passage, 0),
            (4, passage + "1", 0), (4, "2" + passage, 0), (5, passage[:99], 1)]
    _, out = run(spark, rows, 100)
    got = sorted(((r.rest.doc_id or 0, r.n_bytes, r.n_removed) for r in out))
    assert got == [(0, 150, 0), (1, 0, 0), (2, 0, 0), (3, 150, 150), (3, 150, 150),
                   (4, 151, 150), (4, 151, 150), (5, 99, 0)]
    # rows with the same id and text are one document: the first of its kind loses nothing
    _, out = run(spark, [(3, passage, 0), (3, passage, 0)], 100)
    assert [r.n_removed for r in out] == [0, 0]
    none = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("hot", [20_000, 0])
def test_repeated_rows_are_one_document_when_refined(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(3)
    t, u, v = ("".join(rng.choice(list("abcdef "), n)) for n in (400, 200, 200))
    # 90 bytes hold q-grams of zones, but no window; the last document holds windows
    rows = [(7, t, 0), (7, t, 0), (9, u + t[50:140] + v, 0), (11, v[:90] + t[200:350], 0)]
    want = [size for _, size, _, _ in brute([text.encode() for _, text, _ in rows[1:]], 100)]
    _, out = run(spark, rows, 100)
    assert want[0] == want[1] == 0 < want[2]
    assert sorted((r.rest.doc_id, r.n_removed) for r in out) == [
        (7, 0), (7, want[0]), (9, want[1]), (11, want[2])]
