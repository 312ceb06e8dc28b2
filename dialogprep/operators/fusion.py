"""Embedding lookup, projection and prepending of image positions."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.operators.skew import salted_join
from dialogprep.sources.scratch import stored

# Largest embedding table held by every Python worker, in bytes of float32; it
# passes the driver once. A larger one is joined.
MAX_SHARED_TABLE = 1 << 27
OUTPUT_BYTES = 1 << 26

# erf by polynomials on equal pieces of [0, ERF_END]; beyond, it is 1 in double precision.
ERF_END, ERF_PIECES, ERF_DEGREE = 6.0, 96, 8


def _erf_pieces() -> np.ndarray:
    """(degree + 1, pieces): coefficients through the values at Chebyshev nodes."""
    nodes = np.cos((np.arange(ERF_DEGREE + 1) + 0.5) * np.pi / (ERF_DEGREE + 1))
    at = (np.arange(ERF_PIECES)[:, None] + (nodes + 1) / 2) * (ERF_END / ERF_PIECES)
    values = np.array([[math.erf(v) for v in row] for row in at])
    return np.linalg.solve(np.vander(nodes, increasing=True), values.T)


_ERF = _erf_pieces()


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of an array, to about 1e-15; NaN stays NaN."""
    place = np.minimum(np.abs(x), ERF_END) * (ERF_PIECES / ERF_END)
    piece = np.minimum(np.nan_to_num(place).astype(np.int64), ERF_PIECES - 1)
    u = 2 * (place - piece) - 1
    out = _ERF[-1][piece]
    for row in _ERF[-2::-1]:
        out *= u
        out += row[piece]
    return np.copysign(out, x)


def gelu(x: np.ndarray) -> np.ndarray:
    # Minus infinity times zero is taken as the limit.
    return np.where(x == -np.inf, 0.0, x) * (0.5 * (1.0 + erf(x / math.sqrt(2.0))))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), width)


def _rows(matrix: np.ndarray) -> pa.Array:
    steps = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(steps, pa.int32()), pa.array(matrix.ravel()))


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _pieces(batches: Iterator[pa.Array], row_bytes) -> Iterator[pa.Array]:
    """Slices whose output stays near ``OUTPUT_BYTES``; results outgrow inputs."""
    for whole in batches:
        rows = max(1, OUTPUT_BYTES // max(1, row_bytes(whole)))
        for start in range(0, len(whole), rows):
            yield whole.slice(start, rows)


def _longest(lists: pa.Array) -> int:
    return pc.max(lists.value_lengths()).as_py() or 1


def _apply(vectors: Column, stages, out_width: int, sequence: bool) -> Column:
    """Column of ``stages(matrix)`` over vectors, or over arrays of vectors.

    ``stages`` is called in the worker and returns (in_width, function).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        in_width, compute = stages()
        per_row = lambda part: 8 * out_width * (_longest(part) if sequence else 1)
        for part in _pieces(batches, per_row):
            if not sequence:
                yield _rows(compute(_matrix(part, in_width)))
            else:
                inner = _rows(compute(_matrix(part.flatten(), in_width)))
                yield pa.ListArray.from_arrays(_offsets(part), inner)

    return F.arrow_udf(run, "array<array<double>>" if sequence else "array<double>")(vectors)


def linear(
    spark: SparkSession, vectors: Column, weight: np.ndarray, bias: np.ndarray,
    sequence: bool = False,
) -> Column:
    """x W^T + b for ``weight`` of shape (out, in), one matrix product per batch.

    ``sequence`` says that a row holds an array of vectors.
    """
    shared = spark.sparkContext.broadcast((np.asarray(weight, float), np.asarray(bias, float)))

    def stages():
        w, b = shared.value
        return w.shape[1], lambda x: x @ w.T + b

    return _apply(vectors, stages, len(bias), sequence)


def project(spark: SparkSession, vectors: Column, layers, sequence: bool = False) -> Column:
    """Linear, exact GELU, linear; ``layers`` is ((W1, b1), (W2, b2))."""
    shared = spark.sparkContext.broadcast(
        [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]
    )

    def stages():
        (w1, b1), (w2, b2) = shared.value
        return w1.shape[1], lambda x: gelu(x @ w1.T + b1) @ w2.T + b2

    return _apply(vectors, stages, len(layers[1][1]), sequence)


def load_vectors(table: DataFrame, width: int, limit: int = MAX_SHARED_TABLE) -> np.ndarray | None:
    """A (rows, width) matrix from (id, vec); None when it would exceed ``limit`` bytes."""
    most = limit // (4 * width)
    if table.limit(most + 1).count() > most:
        return None
    rows = table.select("id", "vec").toArrow()
    ids = rows["id"].to_numpy()
    if sorted(ids.tolist()) != list(range(len(ids))):
        raise ValueError("vector ids must run from 0 without gaps")
    matrix = np.empty((len(ids), width), dtype=np.float32)
    matrix[ids] = rows["vec"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return matrix


def lookup_shared(spark: SparkSession, ids: Column, matrix: np.ndarray) -> Column:
    """ids -> float vectors with the table on every worker; no shuffle.

    An id that the table lacks, such as the reserved negative ones, gives null.
    A row of vectors is far larger than its ids, so batches go out in pieces.
    """
    shared = spark.sparkContext.broadcast(matrix)

    @F.arrow_udf("array<array<float>>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        width = table.shape[1]
        for lists in _pieces(batches, lambda part: 4 * width * _longest(part)):
            wanted = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            absent = (wanted < 0) | (wanted >= len(table))
            taken = _rows(table[np.where(absent, 0, wanted)] if len(table) else
                          np.zeros((len(wanted), width), np.float32))
            if absent.any():
                taken = pa.ListArray.from_arrays(taken.offsets, taken.values, mask=pa.array(absent))
            yield pa.ListArray.from_arrays(_offsets(lists), taken)

    return apply(ids)


def lookup_by_join(
    df: DataFrame, key: list[str], ids: str, table: DataFrame, out: str = "vectors", **skew
) -> DataFrame:
    """(key, vectors) through a join, for a table too large to share; common
    ids are salted. Samples are truncated, so a group is at most that long.
    Types and unknown ids are those of ``lookup_shared``."""
    table = table.select("id", F.col("vec").cast("array<float>").alias("vec"))
    spread = df.select(*key, F.posexplode_outer(ids).alias("pos", "id"))
    joined = salted_join(spread, table.select("id", "vec"), ["id"], [*key, "pos"], **skew)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "vec"))
    return (
        joined.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_v"))
        .select(*key, F.transform("_v", lambda e: e["vec"]).alias(out))
    )


def embed(
    df: DataFrame, key: list[str], ids: str, table: DataFrame, width: int,
    out: str = "vectors", limit: int = MAX_SHARED_TABLE,
) -> DataFrame:
    """Adds the vectors of an id array, by shared table or by join.

    For the join, rows are numbered and written once, so that equal keys stay
    apart; ``key`` then only spreads the rows of common ids.
    """
    matrix = load_vectors(table, width, limit)
    if matrix is not None:
        return df.withColumn(out, lookup_shared(df.sparkSession, F.col(ids), matrix))
    numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return numbered.drop(out).join(lookup_by_join(numbered, ["_row"], ids, table, out), "_row").drop("_row")
