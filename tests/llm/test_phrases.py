import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dialogprep.llm import automata, phrases
from dialogprep.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SF


def brute(rows, least, covered, best):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + s]: 0 for p in found for s in (2, 3) for i in range(len(p) - s + 1) if s < len(p)}
        for p, a in found.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    inside[p[i:i + s]] = max(inside[p[i:i + s]], a)
        listed = []
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:best], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def corpus(n=400):
    rng = np.random.default_rng(8)
    words = ["The", "quick", "brown", "été", "of", "of", "of", "the", "xσ", " nb", "a\x1fb", "New", "York", "City"]
    rows = []
    for i in range(n):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" "] * 9 + ["\t ", ". ", "\n", "\x0b", ";x "]))
                       for _ in range(rng.integers(0, 50)))
        rows.append((["en", "fr", None, "und"][i % 4 if i % 3 else 0], text + " New York City hall"))
    return rows + [("en", None), ("de", ""), ("it", " .,; "), ("und", "one"), rows[0], rows[0],
                   ("en", "same same same same " * 300)]


def answered(spark, rows, **options):
    table = spark.createDataFrame([(l, t, "x", 1) for l, t in rows], "lang string, text string, phrase string, n int")
    found = phrases.collocations(table.repartition(4), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = found.collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_query_equals_sql(spark, con):
    name = "op11_phrase_collocations"
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) > 0


@pytest.mark.parametrize("shard,words,bits", [(1 << 24, 2_000_000, 10), (700, 64, 2), (150, 400, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, words, bits):
    """Also with texts cut into parts, many ranges, common first words and several rounds."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "RANGE_WORDS", words)
    monkeypatch.setattr(phrases, "SPLIT_BITS", bits)
    options = dict(least=5, covered=80, best=300)
    assert answered(spark, corpus(), **options) == brute(corpus(), **options)


def test_empty_tables(spark):
    assert answered(spark, []) == set()
    assert answered(spark, [("en", None), (None, ""), ("en", "a b c")]) == set()


def test_parts_see_the_words_behind_them():
    text = b"aa  bb cc dd. ee ff\tgg  hh ii" * 40
    whole, _, _ = phrases._words([(text, b"")])
    for limit in (1, 7, 30, 100):
        parts = list(phrases._parts(text, limit))
        words, _, own = phrases._words(parts)
        assert words.filter(pa.array(own)).to_pylist() == whole.to_pylist()
        assert _table(*phrases.shard_automaton(parts)) == _table(*phrases.shard_automaton([(text, b"")]))


def _table(words, automaton):
    names = [*words.to_pylist(), b"$"]
    return {tuple(names[i] for i in s): w
            for s, w in zip(automaton.sequences().T.tolist(), automaton.weights.tolist())}


def _random(rng, n):
    words = pa.array(sorted({bytes(rng.integers(97, 100, rng.integers(1, 3)).astype(np.uint8)) for _ in range(9)}),
                     pa.large_binary())
    sequences = rng.integers(0, len(words), (4, n)).astype(np.int32)
    sequences[3, ::3] = sequences[2, ::6] = -1
    sequences[3, ::6] = -1
    return words, sequences, rng.integers(1, 300, n)


@pytest.mark.parametrize("n", [0, 1, 50, 2000])
def test_automata(n):
    rng = np.random.default_rng(n)
    wanted, parts = Counter(), []
    for _ in range(3):
        words, sequences, weights = _random(rng, n)
        names = [*words.to_pylist(), b"$"]
        for s, w in zip(sequences.T.tolist(), weights.tolist()):
            wanted[tuple(names[i] for i in s)] += w
        made = automata.Automaton.of(sequences, weights)
        parts.append(automata.unpacked(automata.packed(words, made)))
        assert _table(*parts[-1]) == _table(words, made)
    words, whole = automata.union(parts)
    assert _table(words, whole) == dict(wanted)
    assert words.to_pylist() == sorted(words.to_pylist())
    names = [*words.to_pylist(), b"$"]
    for length in range(1, 5):
        sums = Counter()
        for s, w in wanted.items():
            sums[s[:length]] += w
        symbols, weights = whole.prefixes(length)
        assert {tuple(names[i] for i in s): w for s, w in zip(symbols.T.tolist(), weights.tolist())} == dict(sums)
