import math

import numpy as np
from pyspark.sql import functions as F

from dialogprep.functions import arrays as ar
from dialogprep.operators import fusion


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(4)
    w1, b1 = rng.normal(size=(8, 16)), rng.normal(size=8)
    w2, b2 = rng.normal(size=(8, 8)), rng.normal(size=8)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<float>")
    got = df.select("i", fusion.project(spark, F.col("x"), ((w1, b1), (w2, b2))).alias("y"),
                    fusion.linear(spark, F.col("x"), w1, b1).alias("z")).collect()
    pairs = df.select(
        "i", fusion.project(spark, F.array("x", "x"), ((w1, b1), (w2, b2)), sequence=True).alias("yy")
    ).collect()
    hidden = x.astype(float) @ w1.T + b1
    active = np.array([[0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in row] for row in hidden])
    for r in got:
        assert np.allclose(r.y, (active @ w2.T + b2)[r.i])
        assert np.allclose(r.z, hidden[r.i])
    for r in pairs:
        assert np.allclose(r.yy, [(active @ w2.T + b2)[r.i]] * 2)


def test_lookup_both_ways(spark, monkeypatch):
    table = spark.range(20).select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("id") * 10 + k).cast("float")).alias("vec")
    )
    df = spark.createDataFrame([(1, [3, 0, 3]), (2, []), (3, [19])], "k int, ids array<int>")
    want = {1: [[30, 31, 32], [0, 1, 2], [30, 31, 32]], 2: [], 3: [[190, 191, 192]]}
    monkeypatch.setattr(fusion, "OUTPUT_BYTES", 1)
    for limit in (1 << 20, 12 * 19):
        got = fusion.embed(df, ["k"], "ids", table, 3, limit=limit)
        assert {r.k: r.vectors for r in got.collect()} == want
    assert fusion.load_vectors(table, 3, 12 * 19) is None


def test_unknown_ids_are_null_both_ways(spark):
    table = spark.range(10).select("id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vec"))
    df = spark.createDataFrame(
        [(1, [-100, 3, -200]), (2, [12, 9]), (3, None), (4, [-2, None])], "k int, ids array<int>")
    shared, joined = (fusion.embed(df, ["k"], "ids", table, 2, limit=n) for n in (1 << 20, 8))
    assert shared.schema["vectors"].dataType == joined.schema["vectors"].dataType
    want = {1: [None, [3, 0.5], None], 2: [None, [9, 0.5]], 4: [None, None]}
    for got in (shared, joined):
        rows = {r.k: r.vectors for r in got.collect()}
        assert {k: rows[k] for k in want} == want


def test_erf_of_arrays(spark):
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, -0.0, np.inf, -np.inf, 1e-300]])
    assert np.max(np.abs(fusion.erf(x) - [math.erf(v) for v in x])) < 1e-12
    fusion.gelu(x)  # a call on the driver leaves nothing behind that tasks cannot take
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<float>")
    w, b = np.eye(2), np.zeros(2)
    assert len(df.select(fusion.project(spark, F.col("x"), ((w, b), (w, b)))).first()[0]) == 2


def test_fused_shapes(spark):
    df = spark.createDataFrame(
        [([1, 1, 0], [5, 6, -100]), (None, None)], "m array<int>, l array<int>"
    )
    rows = df.select(ar.fuse_mask(F.col("m"), 2).alias("m"), ar.fuse_labels(F.col("l"), 2).alias("l")).collect()
    assert rows[0].m == [1, 1, 1, 1, 0] and rows[0].l == [-100, -100, 5, 6, -100]
    assert rows[1].m is None and rows[1].l is None


def test_gelu_of_odd_values():
    x = np.array([np.nan, np.inf, -np.inf, 0.0, -40.0])
    out = fusion.gelu(x)
    assert np.isnan(out[0]) and out[1] == np.inf and out[2:].tolist() == [0.0, 0.0, 0.0]
    assert np.isnan(fusion.erf(np.array([np.nan, 1.0]))[0])


def test_joined_vectors_keep_repeated_keys_apart(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, vec array<float>")
    rows = spark.createDataFrame([(1, [0, 2]), (1, [4]), (2, []), (2, None), (None, [7])], "k int, ids array<int>")
    shared, joined = (
        sorted(map(str, fusion.embed(rows, ["k"], "ids", table, 2, limit=limit).collect())) for limit in (1 << 20, 8))
    assert len(shared) == len(joined) == 5
    assert [r.replace("vectors=None", "vectors=[]") for r in shared] == [r.replace("vectors=None", "vectors=[]") for r in joined]
