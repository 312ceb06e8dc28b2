import re

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dialogprep.llm import decontaminate
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def plain(text):
    data = "".join(c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xDE and c != "×" else c
                   for c in text).encode()
    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", data).removeprefix(b" ")


def distance(window, text):
    """Least edits between ``window`` and any string in ``text``."""
    row = np.zeros(len(text) + 1, int)
    for k, byte in enumerate(window, 1):
        differ = np.frombuffer(text, np.uint8) != byte
        after = np.concatenate([[k], np.minimum(row[:-1] + differ, row[1:] + 1)])
        row = np.minimum.accumulate(after - np.arange(len(after))) + np.arange(len(after))
    return int(row.min())


def brute(text, item):
    """(least edits, first window, last window) by aligning every window."""
    own, data = plain(item), plain(text)
    size = min(len(own), decontaminate.WINDOW)
    if len(own) < decontaminate.GRAM:
        return None
    most = max(0, min(decontaminate.EDITS * size // decontaminate.WINDOW,
                      size // decontaminate.GRAM - 1))
    found = [(distance(own[i:i + size], data), i) for i in range(len(own) - size + 1)]
    found = [(e, i) for e, i in found if e <= most]
    return (min(found)[0], found[0][1], found[-1][1]) if found else None


def changed(rng, text, edits):
    for _ in range(edits if text else 0):
        at = int(rng.integers(0, max(1, len(text))))
        text = text[:at] + ["", "q", text[at:at + 1] + "z"][int(rng.integers(0, 3))] + text[at + 1:]
    return text


def test_equals_aligning_everything(con, monkeypatch):
    """Also where each text is cut into slices, and slices are taken item by item."""
    rng = np.random.default_rng(5)
    items = [t for (t,) in con.execute("SELECT text FROM benchmark LIMIT 6").fetchall()]
    items += ["short item no", "tiny", items[0][:100], "A b " * 30]
    prose = [t for (t,) in con.execute("SELECT text FROM documents LIMIT 20").fetchall()]
    texts = [prose[0][:300], "", "x", items[0], items[1].upper(), items[2][30:130]]
    for k in range(40):
        item = items[k % len(items)]
        part = item[int(rng.integers(0, 20)):][:int(rng.integers(60, 200))]
        texts.append(prose[k % 20][:150] + changed(rng, part, int(rng.integers(0, 12))) + prose[3][:90])
    index = decontaminate.Items(list(enumerate(items)))
    want = {(t, i): found for t, text in enumerate(texts) for i, item in enumerate(items)
            if (found := brute(text, item))}
    assert len(want) > 20
    ends = []
    for pairs, size in ((1 << 20, 2048), (2_000, 300), (40, 300)):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        monkeypatch.setattr(decontaminate, "SLICE", size)
        found = list(decontaminate._found(pa.array(texts), index))
        assert {(t, i): tuple(rest[:3]) for t, i, *rest in found} == want
        ends.append(sorted((t, i, rest[3]) for t, i, *rest in found))
    assert ends[0] == ends[1] == ends[2]


def test_query_finds_copies_and_nothing_else(spark, con):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_passages"](spark, SF).collect()}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    copies = {(d, i) for d, text in docs for i, item in items if item in text}
    assert copies and copies <= got
    for doc_id, item_id in got - copies:
        assert brute(dict(docs)[doc_id], dict(items)[item_id])


@pytest.mark.parametrize("block,chunk", [(4 << 20, 1 << 20), (150, 2000)])
def test_tables(spark, con, monkeypatch, block, chunk):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    items = con.execute("SELECT item_id, text FROM benchmark LIMIT 3").fetchall()
    (prose,) = con.execute("SELECT text FROM documents ORDER BY length(text) DESC").fetchone()
    rows = [(1, None, 1), (2, "", 1), (3, prose, 1), (4, prose + " " + items[1][1], 1),
            (4, prose + " " + items[1][1], 1), (None, items[2][1], 1),
            (5, prose[:5000] + items[0][1] + prose * 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (7, None), (8, "")], "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in got) == sorted(
        [(4, items[1][0], 0), (4, items[1][0], 0), (0, items[2][0], 0), (5, items[0][0], 0)])
    ends = {r.doc_id: r.text_end for r in got}
    assert abs(ends[4] - len((prose + " " + items[1][1]).encode())) <= 2
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 7


@pytest.mark.parametrize("word,text_bytes,item_bytes", [
    ("ha ", 510_000, 3_000), ("buy this cheap watch now ", 486_000, 3_200), ("x", 300_000, 4_000)])
def test_repetitive_texts_take_bounded_memory(word, text_bytes, item_bytes):
    """As many pairs of q-grams as text bytes times item bytes, or a part of them."""
    text = "At first. " + word * (text_bytes // len(word))
    items = decontaminate.Items([(1, word * (item_bytes // len(word))), (2, "at first glance there is no passage here")])
    tracemalloc.start()
    began = time.time()
    try:
        found = list(decontaminate._found(pa.array([text]), items))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    ((row, item, edits, first, last, end),) = found
    size = len(plain(word * (item_bytes // len(word))))
    assert (row, item, edits, first) == (0, 0, 0, 0) and last == size - decontaminate.WINDOW
    assert end >= len(text.rstrip()) - 1
    assert peak < 600e6 and time.time() - began < 120


def test_slices_take_equal_parts_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    seen = []
    real = decontaminate.Items._bounded
    monkeypatch.setattr(decontaminate.Items, "_bounded", lambda self, *a: seen.append(1) or real(self, *a))
    word = "ab" * 4
    items = decontaminate.Items([(1, word * 30)])
    found = list(decontaminate._found(pa.array([word * 20_000]), items))
    assert found == [(0, 0, 0, 0, len(word) * 30 - decontaminate.WINDOW, len(word) * 20_000)]
    assert len(seen) < 60
