"""Softmax and loss terms per position.

Two forms. The column form binds max, then log-sum-exp, so that no lambda
recomputes a reduction; it suits narrow vectors. The Arrow form works on whole
batches with numpy and suits vocabulary-wide vectors.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogprep import fixed


def bind(value, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per use.

    Inside a lambda the optimizer may otherwise inline it per element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def log_sum_exp(logits, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x.cast("double") / F.lit(temperature))
    total = lambda xs, peak: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    return bind(scaled, lambda xs: bind(F.array_max(xs), lambda m: m + F.log(total(xs, m))))


def log_softmax(logits, temperature: float = 1.0) -> Column:
    """Column form, for narrow vectors."""
    return bind(log_sum_exp(logits, temperature), lambda lse: F.transform(
        logits, lambda x: x.cast("double") / F.lit(temperature) - lse))


def softmax(logits, temperature: float = 1.0) -> Column:
    """Column form, for narrow vectors."""
    return bind(log_sum_exp(logits, temperature), lambda lse: F.transform(
        logits, lambda x: F.exp(x.cast("double") / F.lit(temperature) - lse)))


def log_softmax_wide(logits, temperature: float = 1.0, exponentiate: bool = False) -> Column:
    """Arrow form, for vectors as wide as a vocabulary."""

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values, sizes, full, starts = _flat(lists)
            out = _log_softmax(values, sizes, full, starts, temperature)
            steps = np.concatenate([starts, [len(values)]]).astype(np.int32)
            yield pa.ListArray.from_arrays(
                pa.array(steps), pa.array(np.exp(out) if exponentiate else out)
            )

    return scores(logits)


def _flat(lists: pa.Array):
    """Values, row sizes, which rows have values, and where each row starts."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    full = sizes > 0
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return values, sizes, full, starts


def _log_softmax(values, sizes, full, starts, temperature):
    values = values / temperature
    if not full.any():
        return values
    peaks = np.repeat(np.maximum.reduceat(values, starts[full]), sizes[full])
    sums = np.add.reduceat(np.exp(values - peaks), starts[full])
    return values - peaks - np.repeat(np.log(sums), sizes[full])


def _ce_terms(lists, labels):
    """(values, counted): -log softmax(logits)[label], and where it counts."""
    values, sizes, full, starts = _flat(lists)
    logp = _log_softmax(values, sizes, full, starts, 1.0)
    want = labels.to_numpy(zero_copy_only=False)
    counted = want != fixed.IGNORE_INDEX
    if ((want < 0) | (want >= sizes))[counted].any():
        raise ValueError("label outside the vocabulary")
    out = np.zeros(len(want))
    out[counted] = -logp[(starts + want)[counted]]
    return out, counted


def _kl_terms(mine, theirs, temperature):
    """(values, same): sum p_t (log p_t - log p_s), and where widths agree."""
    same = (
        mine.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        == theirs.value_lengths().fill_null(-2).to_numpy(zero_copy_only=False)
    )
    out = np.zeros(len(same))
    if same.any():
        keep = pa.array(same)
        values, sizes, full, starts = _flat(mine.filter(keep))
        log_s = _log_softmax(values, sizes, full, starts, temperature)
        log_t = _log_softmax(_flat(theirs.filter(keep))[0], sizes, full, starts, temperature)
        p_t = np.exp(log_t)
        with np.errstate(invalid="ignore"):
            parts = np.where(p_t > 0, p_t * (log_t - log_s), 0.0)
        rows = np.zeros(len(sizes))
        if full.any():
            rows[full] = np.add.reduceat(parts, starts[full])
        out[same] = rows
    return out, same


def _label_or_ignored(label) -> Column:
    return F.coalesce(label, F.lit(fixed.IGNORE_INDEX)).cast("long")


def cross_entropy(logits, label) -> Column:
    """-log softmax(logits)[label]; null where the label is null or ignored."""

    @F.arrow_udf("double")
    def term(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, labels in batches:
            ce, counted = _ce_terms(lists, labels)
            yield pa.array(ce, mask=~counted)

    return term(logits, _label_or_ignored(label))


def loss_terms(student, teacher, label, temperature: float) -> Column:
    """struct<ce, kl> of a position in one pass: ce as in ``cross_entropy``; kl
    of teacher to student, null where the widths differ or there is no teacher."""

    @F.arrow_udf("struct<ce:double,kl:double>")
    def terms(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for mine, theirs, labels in batches:
            ce, counted = _ce_terms(mine, labels)
            kl, same = _kl_terms(mine, theirs, temperature)
            yield pa.StructArray.from_arrays(
                [pa.array(ce, mask=~counted), pa.array(kl, mask=~same)], names=["ce", "kl"]
            )

    return terms(student, teacher, _label_or_ignored(label))
