import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogprep.llm import lm_score
from dialogprep.llm import recurrent as net
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows, held):
    """{id: (n_tokens, n_known, all, base score)}"""
    counts = Counter(t for (d, text), h in zip(rows, held) if not h for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, text in rows:
        own = tokens(text)
        logs = sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        out.append((d, len(own), sum(counts[t] > 0 for t in own), total, logs))
    return out


def test_query_base_equals_brute_force_and_model_beats_it(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    got = {r.doc_id: r for r in QUERIES["op6_recurrent_scores"](spark, SF).collect()}
    assert len(got) == len(rows)
    gain = 0
    for (d, n, known, total, logs), h in zip(base(rows, held), held):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert abs(r.base_score - logs) < 1e-6 * abs(logs)
        gain += (r.score - r.base_score) * h
    assert gain > 0


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARED", 5)
    monkeypatch.setattr(lm_score, "COUNTED_AT_ONCE", 10)
    monkeypatch.setattr(net, "WORDS", 3)
    rows = [(1, "a b c a d e f g"), (2, "A a b\tnew"), (3, None), (4, ""), (5, "g h g i j k"),
            (5, "g h g i j k"), (None, "a new one g"), (6, "x " * 3000)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = lm_score.score(docs.repartition(3), F.col("doc_id") != 2).collect()
    held = [d is None or d == 2 for d, _ in rows]
    want = sorted(base(rows, held), key=str)
    for r, w in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_tokens))), want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * abs(w[4]) and r.score < 0
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0
    none = lm_score.score(docs, F.lit(False)).collect()
    assert {r.base_score for r in none} == {0.0} and {r.n_known for r in none} == {0}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(net, "WINDOW", 4)
    counts = np.arange(1, 41)
    return net.initial(counts)


def test_predictions_are_a_distribution(small):
    texts = [np.array([i, j]) for j in range(40) for i in (3,)]
    first = net.score(small, [np.array([3])])[0]
    assert abs(np.exp(net.score(small, texts) - first).sum() - 1) < 1e-4


def test_start_equals_frequencies(small):
    shares = (np.arange(1, 41) + 0.5) / (np.arange(1, 41) + 0.5).sum()
    small["class_out"] *= 0
    small["word_out"] *= 0
    got = net.score(small, [np.array([i]) for i in range(40)])
    assert np.allclose(got, np.log(shares), atol=1e-4)


def test_state_is_carried_and_order_does_not_matter(small, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 40, n) for n in (1, 9, 23, 5, 14, 14)]
    apart = np.array([net.score(small, [t])[0] for t in texts])
    assert np.allclose(net.score(small, texts), apart, atol=1e-4)
    monkeypatch.setattr(net, "WINDOW", 50)
    assert np.allclose(net.score(small, texts), apart, atol=1e-4)


def test_gradients_equal_differences(small):
    rng = np.random.default_rng(1)
    p = {name: value.astype(np.float64) for name, value in small.items()}
    for value in p.values():
        value[value > -1e8] += 0.3 * rng.normal(size=(value > -1e8).sum())
    ids, active = rng.integers(0, 40, (4, 3)), np.array([3, 3, 2, 1])
    state = rng.normal(size=(3, net.HIDDEN)).astype(np.float32)

    def loss(q):
        found, _ = net.Window(q, state, ids, active, False).predictions()
        return -found.mean()

    g = net.Window(p, state, ids, active, True).gradients()
    for name in p:
        flat = np.flatnonzero(np.abs(g[name].reshape(-1)) > 1e-3)
        for at in rng.choice(flat, min(6, len(flat)), replace=False):
            up, down = (dict(p, **{name: p[name].copy()}) for _ in range(2))
            up[name].reshape(-1)[at] += 1e-2
            down[name].reshape(-1)[at] -= 1e-2
            slope = (loss(up) - loss(down)) / 2e-2
            assert abs(slope - g[name].reshape(-1)[at]) < 0.02 * abs(slope) + 2e-4, name


def test_training_learns_a_cycle(small):
    texts = [np.tile(np.arange(2, 8), 30) for _ in range(8)]
    adam = net.Adam(small)
    before = net.score(adam.p, texts[:1])[0]
    for _ in range(12):
        net.train(adam, texts)
    assert net.score(adam.p, texts[:1])[0] > before / 3


def test_short_texts_are_all_learned_from(small, monkeypatch):
    learned = []
    gradients = net.Window.gradients

    def counted(window):
        learned.append(int(window.running.sum()))
        return gradients(window)

    monkeypatch.setattr(net.Window, "gradients", counted)
    monkeypatch.setattr(net, "TRAINED_TOGETHER", 16)
    for n in (50, 500):
        learned.clear()
        adam = net.Adam(small)
        for start in range(0, n, 25):
            net.train(adam, [np.arange(2, 9)] * 25)
        assert sum(learned) == 7 * n and adam.steps == len(learned) == 4 * n // 25 and not adam.tokens


def test_every_token_of_long_texts_is_learned_from(small, monkeypatch):
    learned, lengths = [], (3, 4, 5, 90, 131)
    gradients = net.Window.gradients

    def counted(window):
        learned.append(np.sort(window.ids[window.running]))
        return gradients(window)

    monkeypatch.setattr(net.Window, "gradients", counted)
    texts = [np.random.default_rng(n).integers(0, 40, n) for n in lengths]
    net.train(net.Adam(small), texts)
    assert np.array_equal(np.sort(np.concatenate(learned)), np.sort(np.concatenate(texts)))


def test_split_of_the_input_does_not_matter(spark, monkeypatch):
    """Held-out scores of the same texts in 1, 8 and 64 partitions; several trainers."""
    monkeypatch.setattr(lm_score, "TRAINER_TOKENS", 8_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    means = []
    for partitions in (1, 8, 64):
        rows = lm_score.score(docs.repartition(partitions), F.col("doc_id") % 7 != 2).collect()
        held = [r for r in rows if r.doc_id % 7 == 2]
        means.append(sum(r.score for r in held) / sum(r.n_tokens for r in held))
    base = sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert max(means) - min(means) < 1e-3 and min(means) > base


def test_few_long_texts_are_scored_in_few_windows(small, monkeypatch):
    made, window = [], net.Window
    monkeypatch.setattr(net, "Window", lambda *a: made.append(int(a[3].sum())) or window(*a))
    texts = [np.arange(n) % 9 for n in (5_000, 3_000, 1, 40)]
    whole = net.score(small, texts)
    assert sum(made) == 8_041 and len(made) <= 3
    monkeypatch.setattr(net, "SCORED_AT_ONCE", 64)
    assert np.allclose(net.score(small, texts), whole, rtol=1e-5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30) | st.text(alphabet="aAbé \t\x0b\x1c", max_size=30).map(str.encode),
                min_size=1, max_size=6))
def test_words_of_many_texts_are_those_of_each(texts):
    lexicon = lm_score.Lexicon([b"a", b"b", b"ab"], np.array([3, 2, 1]))
    places, rare, times = lexicon.read_all(texts)
    for k, text in enumerate(texts):
        others = Counter()
        assert places[k].tolist() == lexicon.read(text, others).tolist()
        assert dict(zip(rare[k].as_py(), times[k].as_py())) == dict(others)


def test_a_word_is_looked_up_once():
    asked = []
    lexicon = lm_score.Lexicon([b"a"], np.array([3]))
    lexicon.place = type("Place", (), {"get": lambda self, *x: asked.append(x[0]) or -1})()
    lexicon.read_all([b"a b a", b"B a"])
    assert sorted(asked) == [b"a", b"b"]
