import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.functions import logits as lg
from dialogprep.operators import account, scoring
from dialogprep.sources import records

RNG = np.random.default_rng(8)
B, T, V = 3, 5, 7
STUDENT, TEACHER = RNG.normal(size=(B, T, V)) * 3, RNG.normal(size=(B, T, V)) * 3
LABELS = RNG.integers(0, V, size=(B, T))
LABELS[0, 1] = LABELS[2, 4] = -100


def log(spark, labels=LABELS):
    rows = [(b, t, int(labels[b, t]), STUDENT[b, t].tolist()) for b in range(B) for t in range(T)]
    return spark.createDataFrame(rows, "sample_id long, pos long, label int, student array<double>")


def teacher(spark, width=V, skip=()):
    rows = [(b, t, TEACHER[b, t, :width].tolist()) for b in range(B) for t in range(T) if b not in skip]
    return spark.createDataFrame(rows, "sample_id long, pos long, teacher array<double>")


def log_softmax(x):
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def expected(temperature=2.0):
    logp = log_softmax(STUDENT)
    terms = [-logp[b, t, LABELS[b, t + 1]] for b in range(B) for t in range(T - 1) if LABELS[b, t + 1] != -100]
    ls, lt = log_softmax(STUDENT / temperature), log_softmax(TEACHER / temperature)
    kl = (np.exp(lt) * (lt - ls)).sum() / B * temperature ** 2
    return np.mean(terms), kl


def test_losses_match_numpy(spark):
    for temperature, alpha in ((2.0, 0.5), (1.0, 0.9)):
        row = scoring.distillation_loss(
            log(spark), teacher(spark), alpha=alpha, temperature=temperature).first()
        ce, kl = expected(temperature)
        assert math.isclose(row.ce, ce) and math.isclose(row.kl, kl)
        assert math.isclose(row.loss, (1 - alpha) * ce + alpha * kl)
        assert (row.n_samples, row.n_positions) == (B, B * T)


def test_width_mismatch_and_missing_teacher_give_ce(spark):
    ce, _ = expected()
    for other in (teacher(spark, V - 1), teacher(spark, skip=(0, 1, 2)), teacher(spark, skip=(1,)), None):
        row = scoring.distillation_loss(log(spark), other).first()
        assert row.kl is None and math.isclose(row.loss, ce)


def test_nothing_to_count_is_nan(spark):
    row = scoring.distillation_loss(log(spark, np.full((B, T), -100)), None).first()
    assert math.isnan(row.ce) and math.isnan(row.loss) and row.n_counted == 0


def test_label_outside_the_vocabulary_fails(spark):
    with pytest.raises(Exception, match="label outside the vocabulary"):
        scoring.distillation_loss(log(spark, np.full((B, T), V)), None).collect()


def test_last_position_has_no_label(spark):
    rows = scoring.shift_labels(log(spark)).collect()
    for r in rows:
        assert r.next_label == (None if r.pos == T - 1 else LABELS[r.sample_id, r.pos + 1])


def test_kl_can_leave_padding_out(spark):
    row = scoring.distillation_loss(log(spark), teacher(spark), keep=F.col("label") != -100).first()
    ls, lt = log_softmax(STUDENT / 2), log_softmax(TEACHER / 2)
    per = (np.exp(lt) * (lt - ls)).sum(axis=-1)
    assert math.isclose(row.kl, per[LABELS != -100].sum() / B * 4)


def test_extreme_logits(spark):
    row = spark.createDataFrame([([1000.0, -1000.0], [-1000.0, 1000.0])], "s array<double>, t array<double>")
    got = row.select(lg.loss_terms(F.col("s"), F.col("t"), F.lit(1), 1.0).alias("x"),
                     lg.log_softmax("s").alias("n"), lg.log_softmax_wide("s").alias("w")).first()
    assert (got.x.ce, got.x.kl) == (2000.0, 2000.0)
    assert got.n == got.w == [0.0, -2000.0]
    same = row.select(lg.loss_terms(F.col("s"), F.col("s"), F.lit(0), 1.0).alias("x")).first()
    assert (same.x.ce, same.x.kl) == (0.0, 0.0)


def test_both_softmax_forms_agree(spark):
    df = log(spark)
    rows = df.select(
        lg.log_softmax("student", 2.0).alias("a"), lg.log_softmax_wide("student", 2.0).alias("b"),
        lg.softmax("student", 2.0).alias("c"), lg.log_softmax_wide("student", 2.0, True).alias("d"),
    ).collect()
    for r in rows:
        assert np.allclose(r.a, r.b) and np.allclose(r.c, r.d) and math.isclose(sum(r.c), 1.0)


def test_nested_logs_need_equal_lengths(spark):
    good = [(b, LABELS[b].tolist(), STUDENT[b].tolist()) for b in range(B)]
    schema = "sample_id long, labels array<int>, logits array<array<double>>"
    nested = spark.createDataFrame(good, schema)
    row = scoring.distillation_loss(scoring.explode_log(nested), None).first()
    assert math.isclose(row.ce, expected()[0])
    short = spark.createDataFrame([(0, [1, 2], STUDENT[0].tolist())], schema)
    with pytest.raises(Exception, match="differ in length"):
        scoring.explode_log(short).collect()


def test_bucketed_logs_join_without_an_exchange(spark):
    records.write_bucketed(log(spark), "student_log", ["sample_id", "pos"], 4)
    records.write_bucketed(teacher(spark), "teacher_log", ["sample_id", "pos"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paired = scoring.pair_logits(spark.table("student_log"), spark.table("teacher_log"))
        plan = paired._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and paired.count() == B * T
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE student_log")
        spark.sql("DROP TABLE teacher_log")


def test_hidden_state_mse(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0]), ([0.0, 0.0], [3.0, 0.0])], "t array<double>, s array<double>")
    assert scoring.hidden_state_mse(df, "t", "s").first().mse == (4 + 9) / 4


def test_flagged_share(spark):
    df = spark.createDataFrame(
        [("vision", 92_000_000, False), ("text", 490_000_000, False), ("adapter", 8_798_208, True)],
        "name string, numel long, trainable boolean")
    row = account.flagged_share(df, F.col("numel"), F.col("trainable")).first()
    assert (row.flagged, row.total, row.percent) == (8798208, 590798208, 1.49)
    empty = account.flagged_share(df.limit(0), F.col("numel"), F.col("trainable")).first()
    assert (empty.flagged, empty.total, empty.percent) == (0, 0, None)
