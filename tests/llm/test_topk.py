from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.llm import topk
from dialogprep.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SF


def brute(rows, k, step):
    """Rows with equal ids are rows of their own."""
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(usable):
        if q % step:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(usable) if m != n)
        out.update((q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1))
    return out


def test_query_equals_sql(spark, con):
    assert compare(spark, con, "op10", QUERIES["op10_exact_topk"], ORACLES["op10_exact_topk"], SF) > 0


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * rng.choice([0.2, 1.0, 3.0], size=(5, 1))
    rows = [(i, [float(x) for x in centres[i % 5] + spread * rng.normal(size=6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6),
             (None, [1.0] * 6), (204, []), (205, [1.0, 2.0]), (206, [0.0] * 6), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = topk.search(table, F.col("vec_id") % 4 == 0, k=5).collect()
    assert Counter(map(tuple, got)) == brute(rows, 5, 4)


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e5, 2.0]), (1, [1e6, -1e7]), (2, [-3.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(table, F.col("vec_id") % 2 == 0, k=5).collect()
    assert Counter(map(tuple, got)) == brute(rows, 5, 2)


def test_coordinates_lose_nothing():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(4000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for query in unit[:40]:
        for cosine in (0.8, 0.95, 0.999):
            near = topk.Search._by_coordinate(query, cosine, unit, {})
            assert set(np.flatnonzero(unit @ query >= cosine)) <= set(near.tolist())


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(table, F.col("vec_id") % 20 == 0, k=20).count() == 0


def test_repeated_ids_are_rows(spark, con, tmp_path):
    """A third of the rows share one id, some with equal vectors; the query equals its SQL."""
    rng = np.random.default_rng(6)
    rows = [(20 if i % 3 == 0 else i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(90)]
    rows += [rows[0], rows[0], rows[1]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.search(table, F.col("vec_id") % 20 == 0, k=7)
    assert Counter(map(tuple, got.collect())) == brute(exact, 7, 20)
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(spark, own, "op10", QUERIES["op10_exact_topk"], ORACLES["op10_exact_topk"], str(tmp_path)) > 20
