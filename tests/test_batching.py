import pytest
from pyspark.sql import functions as F

from dialogprep.operators import batching

SCHEMA = (
    "idx long, batch_id long, input_ids array<int>, attention_mask array<int>, "
    "labels array<int>, pixel_values array<float>"
)


def features(spark, second_image=150528):
    return spark.createDataFrame(
        [(1, 0, [1, 2, 3], [1, 1, 1], [1, 2, 3], [0.5] * second_image),
         (0, 0, [1, 2], [1, 1], [1, 2], [0.25] * 150528)], SCHEMA
    )


def test_two_samples_pad_to_the_longer(spark):
    row = batching.collate(features(spark), images="pixel_values").first()
    assert row.input_ids == [[1, 2, 0], [1, 2, 3]]
    assert row.attention_mask == [[1, 1, 0], [1, 1, 1]]
    assert row.labels == [[1, 2, -100], [1, 2, 3]]
    assert [len(p) for p in row.pixel_values] == [3 * 224 * 224] * 2
    assert row.pixel_values[0][0] == 0.25


def test_pad_id_and_multiple(spark):
    row = batching.collate(features(spark), pad_id=9, multiple_of=8).first()
    assert row.input_ids == [[1, 2] + [9] * 6, [1, 2, 3] + [9] * 5]
    assert {len(v) for v in row.labels + row.attention_mask} == {8}


def test_unequal_images_cannot_be_stacked(spark):
    with pytest.raises(Exception, match="cannot stack pixel_values"):
        batching.collate(features(spark, 12), images="pixel_values").collect()


def test_one_shuffle_for_all_columns(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = batching.collate(features(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(batch_id") == 1


def test_widths_agree_within_each_batch(spark):
    df = spark.range(40).select(
        F.col("id").alias("idx"), F.expr("id div 4").alias("batch_id"),
        F.sequence(F.lit(0), F.col("id") % 7).cast("array<int>").alias("input_ids"),
    )
    padded = batching.pad_in_batch(df, {"input_ids": 0})
    spread = padded.groupBy("batch_id").agg(F.count_distinct(F.size("input_ids")).alias("n"))
    assert spread.filter("n <> 1").count() == 0
