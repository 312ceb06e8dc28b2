import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dialogprep.llm import languages
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def features(text):
    data = b" " + text.lower().encode() + b" "
    symbols = [c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in data]
    out = Counter()
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b != 32:
            code = a << 16 | b << 8 | c
            out[(code * 2654435761 % 2**32) >> 17] += 1
    return out


def fit(table, n, chosen):
    """Proportions of ``chosen`` languages that make the features likeliest."""
    pi = np.full(len(chosen), 1 / len(chosen))
    p = table[chosen][:, list(n)].T
    weight = np.array(list(n.values()))
    for _ in range(400):
        shares = p * pi
        pi = (weight[:, None] * shares / shares.sum(1, keepdims=True)).sum(0) / weight.sum()
    return pi, float((weight * np.log((p * pi).sum(1))).sum()) / languages.OVERLAP


def best_set(model, text):
    n, table = features(text), model.p.T
    penalty = languages.PENALTY * np.log(sum(n.values()) / languages.OVERLAP + 1)
    alone = [fit(table, n, [i])[1] for i in range(len(table))]
    chosen = [int(np.argmax(alone))]
    while len(chosen) < len(table):
        tries = [(fit(table, n, [*chosen, i])[1], i) for i in range(len(table)) if i not in chosen]
        gain, i = max(tries)
        if gain - fit(table, n, chosen)[1] <= penalty:
            break
        chosen.append(i)
    return chosen, fit(table, n, chosen)[0]


@pytest.fixture(scope="module")
def model(con):
    counts = {}
    for text, lang in con.execute("SELECT text, lang FROM documents").fetchall():
        own = counts.setdefault(lang, np.zeros(languages.BUCKETS, np.int64))
        for bucket, n in features(text).items():
            own[bucket] += n
    return languages.Model(counts)


def test_mixtures_equal_an_exhaustive_fit(con, model):
    texts = [t[:1500] for (t,) in con.execute("SELECT text FROM documents LIMIT 30").fetchall()]
    texts += [a[:600] + " " + b[:900] for a, b in zip(texts[::2], texts[1::2])]
    pi, _ = model.mixtures(len(texts), *languages.counted(pa.array(texts)))
    several = 0
    for own, text in zip(pi, texts):
        chosen, want = best_set(model, text)
        assert set(np.flatnonzero(own)) == set(chosen)
        assert np.allclose(own[chosen], want, atol=0.03)
        several += len(chosen) > 1
    assert several > 2


def test_counts_equal_a_plain_count(spark, con, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = languages.learn(docs)
    again = languages.Model(counts)
    assert again.languages == model.languages and np.array_equal(again.p, model.p)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_language_mixtures"](spark, sf).collect()
    assert len(rows) == len(labels)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == labels[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions) - 1) < 1e-9 for r in rows)


def test_edges(spark, monkeypatch):
    taught = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"),
         (4, "le chat", None)], "doc_id long, text string, lang string")
    counts = languages.learn(taught)
    assert sorted(counts) == ["de", "en"]
    long = "the dog and the cat. " * 150_000
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "12 - 7 …", 0), (4, "The Dog", 0), (4, "The Dog", 0),
         (None, "und die", 1), (5, long, 1), (6, "ÄÖ", 1)], "doc_id long, text string, score int")
    rows = [tuple(r)[:2] for r in languages.predict(docs, counts).collect()]
    got = sorted(rows, key=lambda r: r[0] or 0)
    assert got[:7] == [(None, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"),
                       (5, "en")]
    assert got[7][1] in ("de", "en")
    assert languages.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert languages.predict(docs.limit(0), counts).count() == 0
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        languages.learn(taught)


def test_long_texts_count_as_short_ones(monkeypatch):
    monkeypatch.setattr(languages, "SLICE_BYTES", 50)
    text = "the cat und die katze " * 40
    (one,) = languages.batch_counts(pa.array([text]), 50)
    monkeypatch.setattr(languages, "SLICE_BYTES", 1 << 20)
    (other,) = languages.batch_counts(pa.array([text]), 1 << 20)
    for a, b in zip(one[2], other[2]):
        assert np.array_equal(a, b)


def test_cuts_change_no_count(monkeypatch):
    """Letters, marks of several bytes and no space at all, cut at every place."""
    text = "Straße" * 7 + "ΣΊΣé\U0001F600x" * 9 + "don't İ  end." + "a"
    _, whole, n = languages.counted(pa.array([text]))
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(languages, "SLICE_BYTES", size)
        _, found, counts = languages._long_counted(pa.scalar(text))
        assert found.tolist() == whole.tolist() and counts.tolist() == n.tolist()
