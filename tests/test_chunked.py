import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.operators import chunked, scoring

SCHEMA = "sample_id long, pos int, batch int, label int, student array<double>, teacher array<double>"


def rows(width, n=12):
    rng = np.random.default_rng(width)
    out = []
    for i in range(n):
        student, teacher = (list(map(float, rng.normal(size=width) * 5)) for _ in range(2))
        label = [None, -100, 0, width - 1, int(rng.integers(width))][i % 5]
        out.append((i // 3, i % 3, i // 6, label, student, teacher))
    return out


def both(spark, data, piece, by=("batch",), **options):
    log = spark.createDataFrame(data, SCHEMA)
    cut = lambda name: chunked.cut_log(log, name, piece)
    whole = scoring.distillation_loss(
        log.drop("teacher"), log.select("sample_id", "pos", "teacher").where("teacher IS NOT NULL"), list(by), **options)
    parts = chunked.distillation_loss(
        log.select("sample_id", "pos", "batch", "label"), cut("student"), cut("teacher"), list(by), width=piece, **options)
    key = lambda r: tuple(map(str, r))
    return [sorted((tuple(None if v is None else round(float(v), 8) for v in r) for r in f.select(sorted(f.columns)).collect()), key=key)
            for f in (whole, parts)]


@pytest.mark.parametrize("width,piece", [(10, 3), (10, 10), (10, 100), (1, 1), (50, 7)])
def test_pieces_equal_whole_vectors(spark, width, piece):
    whole, parts = both(spark, rows(width), piece)
    assert whole == parts and len(whole) == 2


def test_options(spark):
    whole, parts = both(spark, rows(9), 4, by=(), alpha=0.2, temperature=3.0, keep=F.col("pos") != 1)
    assert whole == parts


def test_teachers_of_other_widths_or_none(spark):
    data = rows(9, 18)
    data = [(s, p, b, l, x, {0: t, 1: t[:4], 2: (t + [1.0] if p else None)}[b]) for s, p, b, l, x, t in data]
    whole, parts = both(spark, data, 3)
    assert whole == parts


def test_extreme_scores(spark):
    inf = float("-inf")
    data = [(0, 0, 0, 1, [0.0] * 4, [0.0] * 4), (0, 1, 0, 2, [800.0, -800.0, 799.0, 0.0], [-800.0, 800.0, 0.0, 1.0]),
            (1, 0, 0, 2, [inf, 1.0, 2.0, inf], [inf, 5.0, 2.0, inf]), (1, 1, 0, 3, [1.0, inf, 1.0, 1.0], [inf, inf, 1.0, 4.0])]
    whole, parts = both(spark, data, 2)
    assert whole == parts


def test_label_outside_the_vocabulary(spark):
    data = [(0, 0, 0, 0, [1.0, 2.0], [1.0, 2.0]), (0, 1, 0, 2, [1.0, 2.0], [1.0, 2.0])]
    with pytest.raises(Exception, match="label outside"):
        both(spark, data, 1)[1]


def test_no_row_holds_more_than_a_piece(spark):
    log = spark.createDataFrame(rows(50), SCHEMA)
    pieces = chunked.cut_log(log, "student", 7)
    assert pieces.agg(F.max(F.size("student"))).first()[0] == 7 and pieces.count() == 12 * 8
    none = spark.createDataFrame([(0, 0, 0, 0, [], None)], SCHEMA)
    assert chunked.cut_log(none, "student").count() == chunked.cut_log(none, "teacher").count() == 0
