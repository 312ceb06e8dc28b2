import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.operators import generation
from dialogprep.operators.tokens import Codebook


def make_table():
    table = np.random.default_rng(2).normal(size=(30, 30)) * 2
    return lambda ids, lengths: table[ids[np.arange(len(ids)), np.maximum(lengths - 1, 0)]]


def by_hand(prompt, key, most, temperature, stop, seed):
    step, ids = make_table(), list(prompt)
    for n in range(most):
        row = step(np.array([ids or [fixed.PAD_ID]]), np.array([len(ids)]))[0]
        if temperature == 0:
            token = int(np.argmax(row))
        else:
            p = np.exp(row / temperature - (row / temperature).max())
            u = generation.uniform(seed, key, n) * p.sum()
            token = next(i for i in range(len(p)) if p[:i + 1].sum() > u)
        ids.append(token)
        if token in stop:
            break
    return ids[len(prompt):]


@pytest.fixture(scope="module")
def prompts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(0, 30, rng.integers(0, 6))]) for i in range(70)] + [(70, None)]
    return spark.createDataFrame(rows, "k int, ids array<int>"), rows


@pytest.mark.parametrize("temperature,pool,parts", [(0.7, 1, 3), (0.7, 64, 1), (0.7, 5, 8), (0, 7, 2)])
def test_equals_one_row_at_a_time(spark, prompts, temperature, pool, parts):
    frame, rows = prompts
    made = generation.generate(
        F.col("ids"), F.col("k"), make_table, max_new_tokens=12, temperature=temperature,
        stop_ids=[3, 4, 5], seed=9, pool=pool)
    got = {r.k: r.made for r in frame.repartition(parts).select("k", made.alias("made")).collect()}
    assert got.pop(70) is None
    assert got == {k: by_hand(p, str(k), 12, temperature, {3, 4, 5}, 9) for k, p in rows if p is not None}
    lengths = {len(v) for v in got.values()}
    assert max(lengths) == 12 and (temperature == 0 or min(lengths) < 6)


def test_other_seeds_draw_otherwise(spark, prompts):
    draw = lambda seed: generation.generate(F.col("ids"), F.col("k"), make_table, max_new_tokens=5, seed=seed)
    rows = prompts[0].select(draw(1).alias("a"), draw(2).alias("b"), draw(1).alias("c")).collect()
    assert all(r.a == r.c for r in rows) and any(r.a != r.b for r in rows)


def test_limits_and_features(spark, prompts):
    frame, _ = prompts
    none = frame.select(generation.generate(F.col("ids"), F.col("k"), make_table, max_new_tokens=0).alias("x"))
    assert {len(r.x) for r in none.collect() if r.x is not None} == {0}

    def make_feature():
        return lambda ids, lengths, wanted: np.where(np.arange(9)[None, :] == np.array(wanted)[:, None], 0.0, -np.inf)

    made = generation.generate(F.col("ids"), F.col("k"), make_feature, [F.col("k") % 9], max_new_tokens=3, stop_ids=[0])
    for r in frame.select("k", made.alias("x")).where("x IS NOT NULL").collect():
        assert r.x == ([0] if r.k % 9 == 0 else [r.k % 9] * 3)


def test_pick():
    scores = np.log(np.array([[1.0, 2.0, 1.0]] * 5))
    assert generation.pick(scores, 1.0, np.array([0, 0.2499, 0.25, 0.7499, 0.999])).tolist() == [0, 0, 1, 1, 2]
    assert generation.pick(np.array([[1.0, 3.0, 3.0]]), 0, np.zeros(1)).tolist() == [1]
    with pytest.raises(ValueError):
        generation.pick(np.array([[-np.inf, -np.inf]]), 1.0, np.zeros(1))


def test_answers_are_decoded_text(spark):
    words = [*fixed.RESERVED_TOKENS, "user", "assistant", "\n", "Hi", "yes"]
    book = Codebook(spark, [{"id": i, "tok": t, "special": i < 4} for i, t in enumerate(words)])

    def make_reply():
        # "yes" as often as the prompt has ids behind the template's nine, then the end.
        def step(ids, lengths):
            out = np.full((len(ids), 9), -np.inf)
            said = (ids == 8).sum(axis=1)
            out[np.arange(len(ids)), np.where(said < lengths - said - 8, 8, 0)] = 0
            return out
        return step

    rows = spark.createDataFrame([(1, 0, "Hi"), (2, 0, "HiHi"), (3, 1, "Hi Hi")], "conv_id long, turn long, prompt string")
    got = generation.answers(rows, book, make_reply).orderBy("conv_id").collect()
    assert [r.response for r in got] == ["yes", "yes", "yes" * 3]
    assert [r.generated_ids[-1] for r in got] == [0, 0, 0]
