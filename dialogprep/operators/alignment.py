"""A projector that maps student states to the width of the teacher's.

The least-squares projector solves normal equations whose size depends on the
widths alone. Each task sums the products of its rows; the rows of these sums
are added over tasks in two steps, so that no task meets the sums of all others
at once, and the driver solves one system.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.operators import fusion, scoring

# Vectors whose products are taken at once, and groups of the first step of adding up.
ROWS_AT_ONCE, GROUPS = 4_096, 32

_SUMS = pa.schema([("place", pa.int32()), ("part", pa.int32()), ("sums", pa.list_(pa.float64()))])
_DDL = "place int, part int, sums array<double>"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(lists) or lists.null_count:
        raise ValueError(f"states must have {width} values")
    return flat.reshape(len(lists), width)


def _batch(part: int, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    steps = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.RecordBatch.from_arrays([
        pa.array(places, pa.int32()), pa.array(np.full(len(rows), part), pa.int32()),
        pa.ListArray.from_arrays(pa.array(steps), pa.array(rows.ravel()))], schema=_SUMS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows with the same place and part."""
    key, total = None, None
    for batch in batches:
        for place, part, sums in zip(*(batch.column(i) for i in range(3))):
            values = sums.values.to_numpy(zero_copy_only=False)
            own = place.as_py(), part.as_py()
            if own == key:
                total += values
                continue
            if key is not None:
                yield _batch(key[1], total[None], np.array(key[:1]))
            key, total = own, values.copy()
    if key is not None:
        yield _batch(key[1], total[None], np.array(key[:1]))


def products(pairs: DataFrame, student: str, teacher: str, widths: tuple[int, int]) -> np.ndarray:
    """Sums over all pairs of x x' and x t', side by side; x is the student's state and a 1.

    Pairs that lack a state are left out. The result has (width + 1) rows.
    """
    wide, out = widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((wide + 1, wide + 1 + out))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = np.hstack([_matrix(part.column(0), wide), np.ones((part.num_rows, 1))])
                total += x.T @ np.hstack([x, _matrix(part.column(1), out)])
        rows = max(1, (1 << 22) // (8 * total.shape[1]))
        for start in range(0, len(total), rows):
            some = total[start:start + rows]
            yield _batch(TaskContext.get().partitionId() % GROUPS, some, start + np.arange(len(some)))

    present = pairs.select(F.col(student).cast("array<double>").alias("s"), F.col(teacher).cast("array<double>").alias("t"))
    sums = present.where("s IS NOT NULL AND t IS NOT NULL").mapInArrow(run, _DDL)
    sums = sums.repartition("place", "part").sortWithinPartitions("place", "part").mapInArrow(_added, _DDL)
    sums = sums.withColumn("part", F.lit(0)).repartition("place").sortWithinPartitions("place").mapInArrow(_added, _DDL)
    out_rows = np.zeros((wide + 1, wide + 1 + out))
    for row in sums.select("place", "sums").toLocalIterator():
        out_rows[row["place"]] = row["sums"]
    return out_rows


def fit_projector(
    pairs: DataFrame, student: str, teacher: str, widths: tuple[int, int] | None = None, ridge: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """(weight, bias) of shapes (teacher, student) and (teacher): the least squared error of
    student W' + b against teacher. Of several solutions the one of least norm is taken.

    ``widths`` (student, teacher) are looked up in a first row if not given;
    without any pair the projector is zero.
    """
    if widths is None:
        first = pairs.where(F.col(student).isNotNull() & F.col(teacher).isNotNull()).select(
            F.size(student), F.size(teacher)).first()
        if first is None:
            raise ValueError("no pair to learn widths from")
        widths = tuple(first)
    wide = widths[0]
    sums = products(pairs, student, teacher, widths)
    gram = sums[:, :wide + 1] + ridge * np.diag([1.0] * wide + [0.0])
    solved = np.linalg.lstsq(gram, sums[:, wide + 1:], rcond=1e-12)[0]
    return np.ascontiguousarray(solved[:wide].T), solved[wide]


def projected_mse(
    pairs: DataFrame, student: str, teacher: str, projector: tuple[np.ndarray, np.ndarray], by: list[str] = ()
) -> DataFrame:
    """(by, mse): mean squared difference of projected student states and the teacher's."""
    states = pairs.where(F.col(student).isNotNull() & F.col(teacher).isNotNull())
    projected: Column = fusion.linear(pairs.sparkSession, F.col(student), *projector)
    return scoring.hidden_state_mse(states.withColumn("_projected", projected), teacher, "_projected", by)
