"""Image folders: inventory, decoding, model tensors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import pixels as px

ROWS_PER_TENSOR_BATCH = 32
# Tasks that look up a list of files; Spark would start one for each file, and each reports
# to the driver.
LISTING_TASKS = 16
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def normal_path(path) -> Column:
    """One spelling for local paths: file:///a, file:/a and /a are the same."""
    return F.regexp_replace(path, "^(file:)?/+", "file:/")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified); file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        normal_path(F.col("path")).alias("path"), "length",
        F.col("modificationTime").alias("modified"),
    )


def read_images(spark: SparkSession, folder: str | list[str], names: str | None = None) -> DataFrame:
    """(path, height, width, channels, data, readable): every file is a row.

    ``folder`` may be a list of files instead. Files whose names do not match the
    pattern ``names`` are not opened.

    ``data`` is interleaved BGR, BGRA or grey; a file that cannot be decoded has
    ``readable`` false.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", True)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    if isinstance(folder, str):
        decoded = reader.load(folder)
    else:
        before = spark.conf.get(_LISTING)
        spark.conf.set(_LISTING, str(LISTING_TASKS))
        try:
            decoded = reader.load(folder)  # looks the files up at once
        finally:
            spark.conf.set(_LISTING, before)
    # The origin is a URL, in which a plus sign stands for itself.
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    return decoded.select(
        normal_path(origin).alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"), (F.col("image.nChannels") > 0).alias("readable"),
    )


def rgb(images: DataFrame) -> DataFrame:
    """Replaces ``data`` by three-channel ``rgb`` bytes, null if unreadable."""

    @F.arrow_udf("binary")
    def convert(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]
    ) -> Iterator[pa.Array]:
        for columns in batches:
            for start in range(0, len(columns[0]), ROWS_PER_TENSOR_BATCH):
                part = (c.slice(start, ROWS_PER_TENSOR_BATCH).to_pylist() for c in columns)
                yield pa.array(
                    [px.to_rgb(d, h, w, n).tobytes() if n > 0 else None for d, h, w, n in zip(*part)],
                    pa.binary(),
                )

    return images.select(
        "path", "height", "width", "readable",
        convert("data", "height", "width", "channels").alias("rgb"),
    )


def pixel_values(
    images: DataFrame, size: int = fixed.IMAGE_SIZE, method: str = "bilinear",
    mean=fixed.PIXEL_MEAN, std=fixed.PIXEL_STD,
) -> DataFrame:
    """(path, readable, pixel_values, shape) of every image: (3, size, size), flat.

    A file that cannot be decoded keeps its row, with null values. One trip to
    Python from the decoded bytes. Batches go out a few rows at a time because a
    tensor is far larger than its file.
    """
    width = 3 * size * size

    def tensors(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_TENSOR_BATCH):
                part = batch.slice(start, ROWS_PER_TENSOR_BATCH)
                readable = part.column(5).to_pylist()
                shapes = zip(*(part.column(i).to_pylist() for i in (4, 1, 2, 3)))
                made = [
                    px.model_tensor(px.to_rgb(*shape), size, method, mean, std)
                    for shape, ok in zip(shapes, readable) if ok
                ]
                steps = np.concatenate([[0], np.cumsum(np.array(readable) * width)]).astype(np.int32)
                values = pa.ListArray.from_arrays(
                    pa.array(steps), pa.array(np.concatenate([np.zeros(0, np.float32), *made])),
                    mask=pa.array([not ok for ok in readable]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(5), values],
                    names=["path", "readable", "pixel_values"])

    shape = F.when(F.col("readable"), F.array(F.lit(3), F.lit(size), F.lit(size)))
    return (
        images.select("path", "height", "width", "channels", "data", "readable")
        .mapInArrow(tensors, "path string, readable boolean, pixel_values array<float>")
        .withColumn("shape", shape)
    )
