import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dialogprep.llm import mixing
from dialogprep.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SF

SCHEMA = "doc_id long, text string, source string, copies string, target string"


def brute(rows, weights, percent, most, seed):
    """(doc_id, size, source_size, target, copies), by shares given out again and again."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, *_ in rows]
    held = Counter()
    for (_, _, source, *_), n in zip(rows, size):
        held[source] += n
    names = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [None] * (None in held)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    left = sum(size) * percent / 100
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= most * held[s]}
        for s in above or free:
            target[s] = most * held[s] if above else share[s]
            left -= target[s] if above else 0
        free -= above or free
    out = []
    for (doc_id, _, source, *_), n in zip(rows, size):
        rate = target[source] / held[source] if held[source] else 0.0
        key = f"{seed}:{'' if doc_id is None else doc_id}"
        u = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) / 2**32
        out.append((doc_id, n, held[source], round(target[source], 6), int(rate) + (u < rate % 1)))
    return sorted(out, key=str)


def planned(table, **options):
    rows = mixing.plan(table, **options).select("doc_id", "size", "source_size", "target", "copies")
    return sorted(((i, n, s, round(t, 6), c) for i, n, s, t, c in rows.collect()), key=str)


def corpus():
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 7}" if i % 3 else "hot", "x", "y") for i in range(400)]
    rows += [(500, "a b c \x1f\x0b d\r\n", "S", "x", "y"), (501, None, None, None, None),
             (502, "one two", None, "", ""), (None, "three", "", "", ""), (503, "", "empty", "", ""),
             (504, " \t\n" * 9, "empty", "", ""), (505, "tiny", "\U0001F600", "", ""),
             (506, "tiny", "￮", "", ""), rows[5], rows[5]]
    return rows


def test_query_equals_sql(spark, con):
    assert compare(spark, con, "op13", QUERIES["op13_mix_sources"], ORACLES["op13_mix_sources"], SF) > 0


@pytest.mark.parametrize("limit", [10_000, 2])
@pytest.mark.parametrize("limit,weights,percent,most", [
    (10_000, (1, 2, 3), 100, 3), (2, (5, 1), 40, 1), (10_000, (1,), 500, 2)])
def test_equals_brute_force(spark, monkeypatch, limit, weights, percent, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", limit)
    table = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    got = planned(table, weights=weights, percent=percent, most=most, seed=9)
    assert got == brute(corpus(), weights, percent, most, 9)


def test_reruns_and_partitions_agree(spark):
    table = spark.createDataFrame(corpus(), SCHEMA)
    assert planned(table.repartition(1)) == planned(table.repartition(13))


def test_emitted_rows_are_the_planned_copies(spark):
    table = spark.createDataFrame(corpus(), SCHEMA)
    rows = mixing.emitted(table)
    assert rows.columns == [*table.columns, "copy"]
    wanted, got = defaultdict(int), defaultdict(int)
    for doc_id, *_, copies in planned(table):
        wanted[doc_id] += copies
    texts = {r[0]: r[1] for r in corpus()}
    for row in rows.collect():
        got[row["doc_id"]] += 1
        assert row["text"] == texts[row["doc_id"]] and row["target"] in ("y", "", None)
    assert got == {k: n for k, n in wanted.items() if n}


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 3 > 0], "", "") for i in range(30_000)]
    taken, target = Counter(), {}
    for _, source, size, _, goal, copies in mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect():
        taken[source] += size * copies
        target[source] = goal
        assert copies <= 3
    assert sum(target.values()) == pytest.approx(sum(i % 5 + 1 for i in range(30_000)))
    for source, goal in target.items():
        assert taken[source] == pytest.approx(goal, rel=0.03)


def test_empty_table_and_long_text(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.emitted(spark.createDataFrame([], SCHEMA)).count() == 0
    long = spark.createDataFrame([(1, " " * 300_000 + "ab " * 1_000_000, "s", "", "")], SCHEMA)
    assert mixing.plan(long).first()["size"] == 1_000_000


def test_word_count_does_not_depend_on_unicode_spaces(spark):
    row = spark.createDataFrame([(" a\u0085b c\x1cd",)], "text string")
    assert row.select(mixing.word_count(F.col("text"))).first()[0] == 2
