import random

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import batching, index


def test_positions_of_scattered_keys(spark):
    rng = random.Random(11)
    keys = {rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)}
    keys |= {rng.randrange(-(1 << 23), 1 << 23) for _ in range(300)} | set(range(100, 200))
    keys |= {-(1 << 63), (1 << 63) - 1, 0, -1}
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = {r.k: r.idx for r in index.dense_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_null_key_fails(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    with pytest.raises(Exception, match="cannot be positioned"):
        index.dense_index(df, "k").collect()


def test_shuffle_is_a_stable_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = {r.k: r.idx for r in index.shuffled_index(df, "k", 1).collect()}
    again = {r.k: r.idx for r in index.shuffled_index(df.repartition(5), "k", 1).collect()}
    other = {r.k: r.idx for r in index.shuffled_index(df, "k", 2).collect()}
    assert first == again and first != other
    assert sorted(first.values()) == sorted(other.values()) == list(range(500))
    assert sum(first[k] == k for k in range(500)) < 20


def test_only_fixed_size_windows_lack_a_partition(spark):
    plan = index.dense_index(spark.range(10).withColumnRenamed("id", "k"), "k")
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in text.splitlines() if "Window [" in line]
    assert len(lines) == 3
    # The one unpartitioned window runs over parents of 2^40 keys.
    assert sum("windowspecdefinition(bucket" in l and "sum(n" in l for l in lines) == 1


def test_fetch(spark):
    df = spark.createDataFrame([(10, "a"), (30, "c"), (20, "b")], "k long, v string")
    got = index.fetch(df, index.dense_index(df, "k"), "k", [0, 2]).collect()
    assert sorted((r.idx, r.v) for r in got) == [(0, "a"), (2, "c")]


def test_batches_and_steps(spark):
    df = spark.range(18).select(F.col("id").alias("idx"))
    batched = batching.micro_batches(df)
    sizes = {r.batch_id: r["count"] for r in batched.groupBy("batch_id").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2}
    steps = sorted(tuple(r) for r in batching.accumulation_steps(batched).collect())
    assert steps == [(0, 4, 16), (1, 1, 2)]


def test_repeated_keys_fail(spark):
    df = spark.createDataFrame([(1,), (5,), (5,)], "k long")
    for positions in (index.dense_index(df, "k"), index.shuffled_index(df, "k", 3)):
        with pytest.raises(Exception, match="repeated key"):
            positions.collect()
