import time

import pytest
from pyspark.sql import functions as F

from dialogprep.functions import text as tx
from dialogprep.operators import render
from dialogprep.plans import fixtures as fx
from dialogprep.streaming import dialogues
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, is_last boolean"


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "progress")]


def arrive(spark, paths, rows, files=1, **options):
    folder, out, progress = paths
    frame = rows if hasattr(rows, "write") else spark.createDataFrame(rows, SCHEMA)
    frame.repartition(files, F.xxhash64("conv_id", "turn")).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    dialogues.drain_dialogues(dialogues.collect_dialogues(stream, **options), out, progress)
    return spark.read.parquet(out)


def test_shuffled_turns_give_the_dialogues_of_the_batch(spark, paths):
    turns = fx.table(spark, SF, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("m"))
    rows = turns.join(last, "conv_id").select(
        "conv_id", "turn", "role", "text", (F.col("turn") == F.col("m")).alias("is_last"))
    got = arrive(spark, paths, rows, files=5)
    assert {r.status for r in got.collect()} == {"complete"}
    want = render.dialogue_text(render.nest_turns(turns))
    text = lambda df: sorted(map(tuple, df.select(
        "conv_id", tx.grouped_dialogue("conversations"), tx.interleaved_dialogue("conversations")).collect()))
    assert text(got) == text(want)


def test_late_repeated_and_keyless_turns_are_reported(spark, paths):
    first = [(1, 1, "assistant", "b", True), (2, 0, "user", "x", False), (None, 0, "user", "lost", None),
             (3, None, None, None, None)]
    got = arrive(spark, paths, first)
    assert sorted((r.conv_id or 0, r.status) for r in got.collect()) == [(0, "no_key"), (3, "no_key")]
    arrive(spark, paths, [(1, 0, "user", "a", None), (2, 0, "user", "again", False)])
    got = arrive(spark, paths, [(1, 0, "user", "too late", False), (2, 1, "system", None, True)])
    rows = sorted((r.conv_id or 0, r.status, r.n_turns, tuple(tuple(t) for t in r.conversations)) for r in got.collect())
    assert rows == sorted([
        (0, "no_key", 1, (("human", "lost"),)), (3, "no_key", 1, ((None, None),)),
        (1, "complete", 2, (("human", "a"), ("gpt", "b"))), (1, "late", 1, (("human", "too late"),)),
        (2, "repeated", 1, (("human", "again"),)), (2, "complete", 2, (("human", "x"), ("system", None)))])


def test_incomplete_dialogues_leave_by_timer(spark, paths):
    arrive(spark, paths, [(1, 0, "user", "a", False), (1, 2, "user", "c", True), (2, 0, "user", "k", False)], wait_ms=1)
    time.sleep(0.1)
    got = arrive(spark, paths, [(9, 0, "user", "z", True)], wait_ms=1)
    rows = {(r.conv_id, r.status): [t["value"] for t in r.conversations] for r in got.collect()}
    assert rows == {(1, "timeout"): ["a", "c"], (2, "timeout"): ["k"], (9, "complete"): ["z"]}
    got = arrive(spark, paths, [(1, 1, "assistant", "b", False)], wait_ms=1)
    assert (1, "late") in {(r.conv_id, r.status) for r in got.collect()}
