"""Losses over logits that come in pieces of the vocabulary.

A row is (sample_id, pos, chunk, student): the scores of ids from
``chunk * width`` on. Each piece gives a few numbers (its maximum, sums scaled by
it, the label's score), which are put together by position; no row or task holds
a whole vector. Labels are a table of their own: (sample_id, pos, label).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import logits as lg
from dialogprep.operators import scoring

WIDTH = 8_192

_STATE = "struct<n:int,peak:double,total:double,warm_peak:double,warm_total:double,label:double>"
_PAIR = "struct<n:int,peak:double,total:double,cross:double>"


def cut_log(log: DataFrame, scores: str, width: int = WIDTH) -> DataFrame:
    """Rows of whole vectors as rows of pieces; an empty or null vector has none."""
    places = F.sequence(F.lit(0), F.floor((F.size(scores) - 1) / width).cast("int"))
    pieces = F.when(F.size(scores) > 0, F.transform(
        places, lambda c: F.struct(c.alias("chunk"), F.slice(scores, c * width + 1, F.lit(width)).alias(scores))))
    return log.select("sample_id", "pos", F.inline(pieces))


def _sums(values, sizes, full, starts):
    """(maximum, sum of exp(value - maximum), exp(value - maximum)) of each full row; a row of
    impossible scores sums to 0."""
    peaks = np.maximum.reduceat(values, starts[full])
    raised = np.exp(values - np.repeat(np.where(peaks == -np.inf, 0.0, peaks), sizes[full]))
    return peaks, np.add.reduceat(raised, starts[full]), raised


def _student_state(scores: Column, label: Column, temperature: float) -> Column:
    """The numbers of a student's piece; ``label`` is a place within it or null."""

    @F.arrow_udf(_STATE)
    def state(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, labels in batches:
            values, sizes, full, starts = lg._flat(lists)
            columns = np.full((5, len(lists)), -np.inf)
            columns[[1, 3]] = 0
            if full.any():
                columns[0, full], columns[1, full], _ = _sums(values, sizes, full, starts)
                columns[2, full], columns[3, full], _ = _sums(values / temperature, sizes, full, starts)
            at = labels.fill_null(-1).to_numpy(zero_copy_only=False)
            here = (at >= 0) & (at < sizes)
            columns[4, here] = values[(starts + at)[here]]
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int32()), *(pa.array(c) for c in columns[:4]),
                 pa.array(columns[4], mask=~here)],
                names=["n", "peak", "total", "warm_peak", "warm_total", "label"])

    return state(scores, label)


def _teacher_state(student: Column, teacher: Column, temperature: float) -> Column:
    """The numbers of a teacher's piece beside the student's: ``cross`` sums
    exp(t - peak) (t - s) over warm scores. Null where the widths differ."""

    @F.arrow_udf(_PAIR)
    def state(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for mine, theirs in batches:
            same = (mine.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                    == theirs.value_lengths().fill_null(-2).to_numpy(zero_copy_only=False))
            kept = pa.array(same)
            s = lg._flat(mine.filter(kept))[0] / temperature
            values, sizes, full, starts = lg._flat(theirs.filter(kept))
            t = values / temperature
            columns = np.zeros((3, len(same)))
            if full.any():
                places = np.flatnonzero(same)[full]
                columns[0, places], columns[1, places], raised = _sums(t, sizes, full, starts)
                with np.errstate(invalid="ignore"):
                    parts = np.where(raised > 0, raised * (t - s), 0.0)
                columns[2, places] = np.add.reduceat(parts, starts[full])
            wide = np.zeros(len(same), np.int32)
            wide[same] = sizes
            yield pa.StructArray.from_arrays(
                [pa.array(wide, pa.int32()), *(pa.array(c) for c in columns)],
                names=["n", "peak", "total", "cross"], mask=pa.array(~same))

    return state(student, teacher)


def _merged(states: Column, peak: str, total: str) -> Column:
    """Log of the sum of exponentials over all pieces."""
    top = F.array_max(F.transform(states, lambda s: s[peak]))
    return lg.bind(top, lambda m: m + F.log(F.aggregate(
        states, F.lit(0.0), lambda acc, s: acc + s[total] * F.exp(s[peak] - m))))


def position_terms(
    labels: DataFrame, student: DataFrame, teacher: DataFrame | None,
    temperature: float = fixed.TEMPERATURE, width: int = WIDTH, keep: Column | None = None,
) -> DataFrame:
    """``labels`` (sample_id, pos, label, ...) with ce and kl as of whole vectors.

    Positions without any piece of the student are left out, as they have no row
    in a log of whole vectors.
    """
    shifted = scoring.shift_labels(labels)
    wanted = shifted.select("sample_id", "pos", "next_label")
    here = F.when(
        F.expr(f"next_label div {width}") == F.col("chunk"), F.col("next_label") % width).cast("int")
    pieces = student.select("sample_id", "pos", "chunk", "student").join(wanted, scoring.POSITION)
    if teacher is not None:
        pieces = pieces.join(
            teacher.select("sample_id", "pos", "chunk", "teacher"), [*scoring.POSITION, "chunk"], "left")
        # A teacher that is wider has pieces that meet none of the student's.
        beyond = teacher.groupBy(*scoring.POSITION).agg(F.sum(F.size("teacher")).alias("_wide"))
    pair = F.lit(None).cast(_PAIR) if teacher is None else _teacher_state(F.col("student"), F.col("teacher"), temperature)
    states = pieces.select(
        *scoring.POSITION, _student_state(F.col("student"), here, temperature).alias("s"), pair.alias("t"))
    # A few numbers for each piece, and as many pieces as the vocabulary has.
    gathered = states.groupBy(*scoring.POSITION).agg(
        F.collect_list("s").alias("_s"), F.collect_list("t").alias("_t"), F.count("*").alias("_n"),
        F.max("s.label").alias("_label"), F.sum("s.n").alias("_mine"))
    ce = _merged(F.col("_s"), "peak", "total") - F.col("_label")
    counted = F.coalesce(F.col("next_label"), F.lit(fixed.IGNORE_INDEX)) != fixed.IGNORE_INDEX
    outside = F.raise_error(F.lit("label outside the vocabulary")).cast("double")
    joined = shifted.join(gathered, scoring.POSITION)
    kl = F.lit(None).cast("double")
    if teacher is not None:
        joined = joined.join(beyond, scoring.POSITION, "left")
        top = F.array_max(F.transform("_t", lambda t: t["peak"]))
        scaled = lambda name: lg.bind(top, lambda m: F.aggregate(
            "_t", F.lit(0.0), lambda acc, t: acc + t[name] * F.exp(t["peak"] - m)))
        kl = F.when(
            (F.size("_t") == F.col("_n")) & (F.col("_wide") == F.col("_mine")),
            scaled("cross") / scaled("total") - _merged(F.col("_t"), "peak", "total")
            + _merged(F.col("_s"), "warm_peak", "warm_total"))
        if keep is not None:
            kl = F.when(keep, kl).otherwise(F.when(kl.isNotNull(), 0.0))
    return joined.withColumns({
        "ce": F.when(counted, F.when(F.col("_label").isNull(), outside).otherwise(ce)), "kl": kl,
    }).drop("_s", "_t", "_n", "_label", "_mine", "_wide")


def distillation_loss(
    labels: DataFrame, student: DataFrame, teacher: DataFrame | None, by: list[str] = (),
    alpha: float = fixed.ALPHA, temperature: float = fixed.TEMPERATURE, width: int = WIDTH,
    keep: Column | None = None,
) -> DataFrame:
    """``scoring.distillation_loss`` over pieces; ``by`` names columns of ``labels``."""
    terms = position_terms(labels, student, teacher, temperature, width, keep)
    return scoring.losses(terms, by, alpha, temperature)
