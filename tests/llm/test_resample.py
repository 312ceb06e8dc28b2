import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.llm import resample
from dialogprep.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SF


def runs(text, shortest, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i:i + n]) for n in range(shortest, longest + 1)
                   for i in range(len(words) - n + 1)]


def brute(rows, target, percent, fewest, lengths, size, seed):
    place = lambda f: zlib.crc32(f.encode()) % size
    held, wanted = Counter(), Counter()
    for _, text in rows:
        held.update(map(place, runs(text, *lengths)[1]))
    for text in target:
        wanted.update(map(place, runs(text, *lengths)[1]))
    s, t = sum(held.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + size) / ((held[b] + 1) * (t + size))))
            for b in range(size)]
    out = []
    for doc_id, text in rows:
        words, found = runs(text, *lengths)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([len(words), doc_id, len(found), weight, score, None])
    able = sorted((r for r in out if r[0] >= fewest), key=lambda r: (-r[4], r[1] is None, r[1]))
    for rank, row in enumerate(able[:len(able) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, (r[1:] for r in out)), key=str)


def corpus(n=300):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "été", "x1", "zebra's", "ΣΊΣ", " ", "don't", "42"]
    rows = [(int(i * 37 % 1009), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(n)]
    return rows + [(None, "beta " * 30), (None, "beta " * 30), (-5, "alpha " * 25), (rows[0]), (rows[0]),
                   (2**62, "x1 " * 40), (-2**63, "zebra " * 40), (7, None), (8, ""), (9, " \n!"), (10, "a\x00b " * 20)]


def answered(spark, rows, target, **options):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows],
                                 "doc_id long, text string, pos string, block int").repartition(5)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, digit int")
    return sorted(map(tuple, resample.resample(docs, aims, **options).collect()), key=str)


TARGET = ["x1 x1 beta", "zebra s 42 x1", None, "", "unseen words"]


def test_query_equals_sql(spark, con):
    name = "op12_importance_resample"
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) > 0


@pytest.mark.parametrize("lengths,percent", [((1, 1), 10), ((1, 2), 100), ((2, 3), 35)])
def test_equals_brute_force(spark, monkeypatch, lengths, percent):
    monkeypatch.setattr(resample, "BLOCK_BITS", 4)
    options = dict(percent=percent, lengths=lengths, buckets=97, seed=11)
    got = answered(spark, corpus(), TARGET, **options)
    assert got == brute(corpus(), TARGET, percent, 20, lengths, 97, 11)


def test_empty_tables(spark):
    assert answered(spark, [], TARGET) == []
    assert answered(spark, [(1, "a b"), (2, None)], []) == brute(
        [(1, "a b"), (2, None)], [], 10, 20, (1, 1), resample.BUCKETS, resample.SEED)
    only_nulls = [(None, "a " * 30)] * 12
    assert answered(spark, only_nulls, TARGET) == brute(
        only_nulls, TARGET, 10, 20, (1, 1), resample.BUCKETS, resample.SEED)


def test_parts_of_a_long_text_are_its_words():
    text = ("Ab cD,ef  " * 5_000 + "g" * 3_000 + " é" * 100).encode()
    parts = list(resample.word_parts(text, 64))
    assert len(parts) > 100
    assert [w for p in parts for w in p] == resample._WORD.findall(text.lower())
    whole = Counter(runs(text.decode(), 1, 3)[1])
    found = np.concatenate([
        f for _, f in resample.features(text, (1, 3), resample.Buckets(1 << 30), limit=64)])
    assert Counter(found.tolist()) == Counter({zlib.crc32(k.encode()) % (1 << 30): n for k, n in whole.items()})


def test_radix_order_of_many_equal_scores(spark, monkeypatch):
    """A third of the rows share score and id; blocks stay small and places are dense."""
    monkeypatch.setattr(resample, "BLOCK_BITS", 5)
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") * 7919 % 3001 - 1500).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11 - 6).alias("score"),
        F.col("id").alias("pos"))
    out = sorted(resample.radix_sorted(rows).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in out] == list(range(3_000))
    pairs = [(-r["score"], r["doc_id"]) for r in out]
    assert pairs == sorted(pairs)
