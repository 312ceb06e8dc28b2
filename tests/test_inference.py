import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import fixed
from dialogprep.operators import inference, tokens


def test_model_is_made_once_per_worker(spark, tmp_path):
    marks = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{marks}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: x * 2.0

    double = inference.predictor(make, T.DoubleType(), batch_size=10)
    df = spark.range(1000).repartition(4).select(F.col("id").cast("double").alias("x"))
    got = df.select("x", double("x").alias("y")).collect()
    assert all(r.y == 2 * r.x for r in got) and len(got) == 1000
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) <= 8 and len(pids) == len(set(pids))


def test_tokenizer_hook(spark):
    encode = inference.tokenizer(lambda: (lambda texts: [[len(w) for w in t.split()] for t in texts]), 2)
    df = spark.createDataFrame([("a bb",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(encode(F.col("t"))).collect()] == [[1, 2], [], []]
    row = inference.tokenized(df.limit(1), encode, "t", length=3, pad_id=9).first()
    assert (row.input_ids, row.attention_mask) == ([1, 2, 9], [1, 1, 0])


def test_evaluate_end_to_end(spark):
    words = list(fixed.RESERVED_TOKENS) + ["user", "assistant", "\n", "Describe", " ", "this", "image", ".", "Hi"]
    book = tokens.Codebook(spark, [{"id": i, "tok": t, "special": i < 4} for i, t in enumerate(words)])

    def make():
        return lambda image, ids, count: np.where(image[:, :1] > 0, ids[:, 3:6], 2).astype(np.int32)

    predict = inference.predictor(make, T.ArrayType(T.IntegerType()), 2, [[2], [16], None])
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], None), (2, [1.0, 0.0], "Hi Hi"), (3, [-1.0, 0.0], "Hi")],
        "i int, f array<double>, prompt string")
    got = {r.i: r.response for r in inference.evaluate(df, book, predict, "f", length=16).collect()}
    assert got == {1: "Describe this", 2: "Hi Hi", 3: ""}
