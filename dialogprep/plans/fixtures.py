"""Inputs the driver tables lack, derived from them by Spark."""

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.operators import render

VOCABULARY_SIZE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Nested records; the image is named after the dialogue."""
    nested = render.nest_turns(table(spark, folder, "conversations"))
    return nested.select(
        F.col("conv_id").alias("sample_id"),
        F.concat((F.col("conv_id") * 7).cast("string"), F.lit(".png")).alias("image"),
        "conversations",
    )


def image_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, image_id): the image is null where a system turn is present."""
    turns = table(spark, folder, "conversations")
    return turns.groupBy("conv_id").agg(
        F.when(F.max(F.when(F.col("role") == "system", 1).otherwise(0)) == 0,
               F.col("conv_id") * 7).alias("image_id")
    )


def student_log(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.expr("vec_id div 10").alias("sample_id"), (F.col("vec_id") % 10).alias("pos"),
        F.when(F.col("label") == 0, fixed.IGNORE_INDEX).otherwise(F.col("label")).alias("label"),
        F.col("embedding").cast("array<double>").alias("student"),
    )


def teacher_log(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vectors.select(
        F.expr("vec_id div 10").alias("sample_id"), (F.col("vec_id") % 10).alias("pos"),
        F.reverse(F.col("embedding").cast("array<double>")).alias("teacher"),
    )


def weights(rows: int, cols: int, scale: float = 32.0) -> tuple[np.ndarray, np.ndarray]:
    """Small fixed weights: ((31 r + 17 c) mod 13 - 6) / scale, bias (r mod 5 - 2) / scale."""
    r, c = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return ((31 * r + 17 * c) % 13 - 6) / scale, (np.arange(rows) % 5 - 2) / scale


def png_bytes(values: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width, 1, 3 or 4) values."""
    height, width, channels = values.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    lines = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in values)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, channels, values): an 8x8 picture per vector; every 50th is junk
    (channels 0) and every 50th has no file."""
    shade = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))
    kind = F.col("vec_id") % 3
    channels = (
        F.when(F.col("vec_id") % 50 == 49, 0).when(kind == 0, 3).when(kind == 1, 1).otherwise(4)
    )
    return (
        table(spark, folder, "embeddings").filter(F.col("vec_id") % 50 != 48)
        .select(F.col("vec_id").alias("image_id"), channels.alias("channels"), shade.alias("values"))
    )


def write_images(rows: DataFrame, folder: str) -> None:
    """Writes ``<image_id>.png`` files from the tasks; a retry rewrites the same bytes.

    A file takes far longer than its row, so that rows are dealt out to all cores first.
    """

    def write(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        files.create_dir(base, recursive=True)
        for pdf in batches:
            for image_id, channels, values in zip(pdf["image_id"], pdf["channels"], pdf["values"]):
                grey = np.asarray(values).reshape(8, 8, 1)
                planes = {
                    1: [grey],
                    3: [grey, 255 - grey, grey[::-1, ::-1]],
                    4: [grey, 255 - grey, grey[::-1, ::-1], np.full_like(grey, 255)],
                }.get(channels)
                body = b"junk" if planes is None else png_bytes(np.concatenate(planes, axis=2))
                with files.open_output_stream(f"{base}/{image_id}.png") as out:
                    out.write(body)
            yield pdf[["image_id"]]

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(tasks, "image_id").mapInPandas(write, "image_id long").write.format("noop").mode("overwrite").save()


def write_array(rows: DataFrame, folder: str) -> None:
    """A single file that holds all records as one array on one line, by ``sample_id``."""
    first = rows.agg(F.min("sample_id")).scalar()
    record = F.to_json(F.struct("sample_id", "image", "conversations"))
    opened = F.concat(F.when(F.col("sample_id") == first, "[").otherwise(","), record)
    ends = rows.agg(F.max("sample_id").alias("sample_id")).select(
        "sample_id", F.lit(1).alias("place"),
        F.when(F.col("sample_id").isNull(), "[]").otherwise("]").alias("value"))
    parts = rows.select("sample_id", F.lit(0).alias("place"), opened.alias("value")).unionByName(ends)
    parts.coalesce(1).sortWithinPartitions(F.col("sample_id"), "place").select("value").write.option(
        "lineSep", " ").text(folder)
