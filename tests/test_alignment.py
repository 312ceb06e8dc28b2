import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.operators import alignment


def frame(spark, s, t, extra=()):
    rows = [(i % 3, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(zip(s, t))]
    return spark.createDataFrame(rows + list(extra), "g int, student array<float>, teacher array<double>")


@pytest.mark.parametrize("wide,out,rows", [(5, 9, 400), (40, 3, 1000)])
def test_fits_like_numpy(spark, wide, out, rows):
    rng = np.random.default_rng(wide)
    s = rng.normal(size=(rows, wide)).astype(np.float32).astype(float)
    t = s @ rng.normal(size=(wide, out)) + 3 + 0.1 * rng.normal(size=(rows, out))
    pairs = frame(spark, s, t, [(0, None, [1.0] * out), (0, [1.0] * wide, None)]).repartition(7)
    weight, bias = alignment.fit_projector(pairs, "student", "teacher", (wide, out))
    x = np.hstack([s, np.ones((rows, 1))])
    want = np.linalg.lstsq(x, t, rcond=None)[0]
    assert np.allclose(weight, want[:wide].T, atol=1e-6) and np.allclose(bias, want[wide], atol=1e-6)
    error = ((x @ want - t) ** 2)
    assert alignment.projected_mse(pairs, "student", "teacher", (weight, bias)).first()[0] == pytest.approx(error.mean(), rel=1e-6)
    by = {r.g: r.mse for r in alignment.projected_mse(pairs, "student", "teacher", (weight, bias), ["g"]).collect()}
    for g in range(3):
        assert by[g] == pytest.approx(error[g::3].mean(), rel=1e-6)


def test_tree_of_sums_is_whole(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(alignment, "GROUPS", 2)
    s, t = np.arange(60.0).reshape(20, 3), np.arange(40.0).reshape(20, 2)
    sums = alignment.products(frame(spark, s, t).repartition(9), "student", "teacher", (3, 2))
    x = np.hstack([s, np.ones((20, 1))])
    assert np.allclose(sums, x.T @ np.hstack([x, t]))


def test_dependent_states_and_ridge(spark):
    s = np.array([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])
    t = s[:, :1] * 10
    weight, bias = alignment.fit_projector(frame(spark, s, t), "student", "teacher")
    assert np.allclose(s @ weight.T + bias, t, atol=1e-6)
    heavy, mean = alignment.fit_projector(frame(spark, s, t), "student", "teacher", ridge=1e9)
    assert np.allclose(heavy, 0, atol=1e-6) and np.allclose(mean, 20, atol=1e-5)


def test_nothing_to_learn_from(spark):
    empty = frame(spark, [], [])
    with pytest.raises(ValueError):
        alignment.fit_projector(empty, "student", "teacher")
    weight, bias = alignment.fit_projector(empty, "student", "teacher", (2, 3))
    assert weight.shape == (3, 2) and not weight.any() and not bias.any()
    with pytest.raises(Exception, match="states must have"):
        alignment.fit_projector(frame(spark, [[1.0, 2.0], [1.0]], [[1.0], [1.0]]), "student", "teacher")
