"""Reading tables, walking Arrow batches and keeping objects per Python worker."""

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from dialogprep.sources.scratch import scratch_dir

# Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_kept: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once below the shared scratch folder and read back.

    Cuts the lineage: what follows is recomputed from files that outlive any
    executor.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value) -> tuple[str, object]:
    """A broadcast of bounded size with a name that workers can keep it under."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def per_worker(shared: tuple[str, object], build: Callable):
    """What ``build`` makes of a shared value, made once in each Python worker."""
    name, value = shared
    if name not in _kept:
        while len(_kept) >= 2:
            _kept.pop(next(iter(_kept)))
        _kept[name] = build(value.value)
    return _kept[name]


class Remembered(dict):
    """Values by key, made when a key is first met; those of long keys are not kept.

    Of ``most`` values the half met longest ago goes when the other half is full, so that
    what is met again and again is made once however many other keys there are.
    """

    def __init__(self, make: Callable, most: int, length: int):
        self._make, self._half, self._length = make, max(1, most // 2), length
        self._before: dict = {}

    def __missing__(self, key):
        value = self._before.get(key)
        return self.keep(key, self._make(key) if value is None else value)

    def keep(self, key, value):
        if len(key) <= self._length:
            if len(self) >= self._half:
                self._before = dict(self)
                self.clear()
            self[key] = value
        return value

    def holds(self, key) -> bool:
        return key in self or key in self._before


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64) - int(offsets[0]), whole[offsets[0]:offsets[-1]]


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def row_slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        for start, stop in slices(sizes.to_numpy(zero_copy_only=False), limit):
            yield batch.slice(start, stop - start)


def binaries(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def word_lists(data: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists made of about ``limit`` bytes of text."""
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + limit) if len(data) - start > limit else None
        stop = space.start() if space else len(data)
        yield data[start:stop].split()
        start = stop
