from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from dialogprep.llm import graph, jaccard
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def shingles(text, n):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    """{(id, n_shingles, component)} with every pair compared."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc_id, len(sets[i]), (min(ids, default=None) if sets[i] else doc_id)))
    return sorted(out, key=str)


def run(spark, rows, n, num, den):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int")
    out = jaccard.join(docs.repartition(3), n, (num, den))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def test_query_equals_brute_force(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op8_jaccard_join"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("n,num,den,common", [(3, 90, 100, 32), (1, 8, 10, 2), (2, 6, 10, 3)])
def test_equals_brute_force(spark, monkeypatch, n, num, den, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    rng = np.random.default_rng(common)
    rows = []
    for group in range(14):
        size = int(rng.integers(1, 45))
        base = [f"w{rng.integers(0, 400)}" for _ in range(size)]
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, len(words)))
                words[at:at + int(rng.integers(0, 2))] = [f"x{rng.integers(0, 5)}"] * int(rng.integers(0, 2))
                words = words or ["a"]
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, " \n "), (902, "One"), (903, "one"), (904, "ONE two"), (None, "one")]
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_light_boundary_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        base = [f"a{i // 4}b{k}" for k in range(4 + i // 4)]
        base[int(rng.integers(0, len(base)))] = f"c{rng.integers(0, 2)}"
        rows.append((i, " ".join(base)))
    want = brute(rows, 1, 7, 10)
    for light in (0, 6, 9, 12):
        monkeypatch.setattr(jaccard.Rule, "boundary", lambda self, sizes: light)
        assert run(spark, rows, 1, 7, 10) == want


def test_hot_group_and_common_passage(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"g{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 80))] = f"y{i}"
        rows.append((i, " ".join(words)))
    for i in range(150, 300):
        rows.append((i, " ".join(f"r{rng.integers(0, 5000)}" for _ in range(20)) + " " + passage))
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_boundary_has_the_least_cost():
    rule = jaccard.Rule((9, 10))
    assert [rule.subsets(s) for s in (1, 5, 8)] == [1, 1, 1]
    assert rule.subsets(10) == 1 + comb(10, 9)
    assert rule.boundary({5: 1000}) >= 5 and rule.boundary({30: 1000}) < 30


def test_repeats_edges_and_long_texts(spark, monkeypatch):
    assert run(spark, [(1, "a b c d"), (1, "a b c d"), (2, "x"), (2, "y")], 3, 9, 10) == [
        (1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 1, 2)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none, 3, (9, 10)).count() == 0
    texts = pa.array(["One two  three\nfour " * 30 + "w" * 200 + " End", "", "one"])
    (whole,) = jaccard.sets_of(texts, 3)
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    parts = [s for _, _, s in jaccard.sets_of(texts, 3)]
    assert [int(s.n.sum()) for s in parts] == [int(whole[2].n[0]), 1]
    monkeypatch.setattr(jaccard, "CHUNK", 128)
    small = [s for _, _, s in jaccard.sets_of(pa.array(["One two  three\nfour " * 30]), 3)][0]
    assert set(small.shingle.tolist()) <= set(whole[2].shingle.tolist())


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(60)] + [(100, int(i)) for i in rng.integers(101, 130, 40)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    assert {n for n in got if n < 61} == set(range(1, 61)) and {got[n] for n in range(1, 61)} == {0}
    assert {got[n] for n in got if n > 100} == {100}
    assert graph.components(frame.limit(0)).count() == 0
