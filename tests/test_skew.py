import random

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import render, skew, tokens
from dialogprep.plans import jobs


def test_salted_join_equals_a_plain_join(spark):
    rng = random.Random(5)
    left = [(i, 1 if i % 3 == 0 else None if i % 3 == 1 else rng.randrange(50)) for i in range(900)]
    right = [(k, f"v{k}") for k in range(40)] + [(1, "again")]
    a = spark.createDataFrame(left, "i int, k int")
    b = spark.createDataFrame(right, "k int, v string")
    for how in ("left", "inner"):
        got = skew.salted_join(a, b, ["k"], ["i"], how, salts=7, floor=20, share=1e-9)
        want = a.join(b, "k", how).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_heavy_keys_are_few(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in skew.heavy_keys(df, ["k"], 1, 0.1).collect()] == [0]
    assert skew.heavy_keys(df, ["k"], 600, 1e-9).count() == 0


def test_salted_join_spreads_a_hot_key(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    other = spark.range(6000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def largest(joined):
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        plain = largest(df.join(other, "k", "left"))
        salted = largest(skew.salted_join(df, other, ["k"], ["id"], salts=64, floor=100, share=1e-91))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plain > 2500 and salted < 2100


def hot_turns(spark, n_hot=500):
    rows = [(7, t, "user" if t % 3 else "assistant", f"hot {t} word") for t in range(n_hot)]
    rows += [(c, t, r, f"cold {c} {t}") for c in range(5) for t, r in enumerate(("system", "user", "assistant"))]
    rows += [(6, 0, "system", "only")]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


def rendered(rows, conv, order):
    keep = [r for r in rows if r[0] == conv and r[2] in ("user", "assistant")]
    half = (lambda r: r[2] == "assistant") if order == "grouped" else (lambda r: 0)
    keep.sort(key=lambda r: (half(r), r[1]))
    return "".join(f"<|im_start|>{r[2]}\n{r[3]}<|im_end|>\n" for r in keep)


def test_heavy_dialogue_is_one_row_or_comes_in_blocks(spark):
    df, rows = hot_turns(spark)
    nested = render.nest_turns(df)
    for order in ("grouped", "interleaved"):
        texts = {r.conv_id: r.text for r in render.dialogue_text(nested, order).collect()}
        assert texts == {conv: rendered(rows, conv, order) for conv in [*range(5), 6, 7]}
        parts = {}
        blocks = render.dialogue_blocks(df, order, turns_per_block=40)
        for r in blocks.orderBy("conv_id", "part").collect():
            parts.setdefault(r.conv_id, []).append(r.text)
        assert len(parts[7]) > 10 and {c: "".join(p) for c, p in parts.items()} == texts


def test_turns_of_no_dialogue_are_told_apart(spark):
    df, _ = hot_turns(spark)
    lost = df.limit(9).withColumn("conv_id", F.lit(None).cast("long"))
    both = df.unionByName(lost)
    assert render.nest_turns(both).count() == render.nest_turns(df).count()
    assert render.unkeyed(both).groupBy("reason").count().collect() == [("no_key", 9)]
    codebook = tokens.load_codebook(jobs.corpus_vocabulary(df, 2000))
    assert tokens.sample_ids(both, codebook, 60).filter("conv_id is null").count() == 0


def test_heavy_dialogue_is_cut_before_encoding(spark):
    df, rows = hot_turns(spark)
    codebook = tokens.load_codebook(jobs.corpus_vocabulary(df, 2000))
    for order in ("grouped", "interleaved"):
        whole = tokens.sample_ids(df, codebook, 60, order)
        cut = tokens.sample_ids(df, codebook, 60, order, heavy_floor=50, heavy_share=1e-9)
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
        lengths = {r.conv_id: len(r.ids) for r in cut.collect()}
        assert lengths[7] == 60 and lengths[6] == 0 and len(lengths) == 7


def test_cut_heavy_keeps_only_the_first_rows(spark):
    df, rows = hot_turns(spark)
    left = skew.cut_heavy(df, "conv_id", ["turn"], 12, floor=100, share=1e-9)
    kept = [r.turn for r in left.filter("conv_id = 7").collect()]
    assert sorted(kept) == list(range(12))
    assert left.filter("conv_id <> 7").count() == 16


def test_a_share_of_zero_is_refused(spark):
    df, _ = hot_turns(spark)
    with pytest.raises(ValueError):
        skew.heavy_keys(df, ["conv_id"], 10, 0.0)
