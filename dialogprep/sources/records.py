"""Instruction records as JSON or Parquet.

Reading JSON loses nothing: every text ends up as records or as quarantined
text. A file that is an array, on one line or many, is read in splits
(``json_array``). Other files are taken line by line (a line may hold a record or
an array of records); if a line cannot be read but the file as a whole can, as
when one record is printed over several lines, it is one document.
"""

import functools
import json
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogprep import schemas
from dialogprep.sources import json_array
from dialogprep.sources.scratch import stored

ROWS_AT_ONCE = 4_096

_TURN = pa.struct([("from", pa.string()), ("value", pa.string())])
_PARSED = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()),
    ("sample_id", pa.int64()), ("image", pa.string()), ("conversations", pa.list_(_TURN)),
    (schemas.CORRUPT, pa.string()),
])
_PARSED_DDL = (
    "file string, block long, at long, sample_id long, image string, "
    f"conversations array<struct<from:string,value:string>>, {schemas.CORRUPT} string"
)


def _text(value) -> str | None:
    """A string, or ValueError if it cannot be stored, as half of a surrogate pair cannot."""
    if value is not None:
        if not isinstance(value, str):
            raise ValueError("not text")
        value.encode()
    return value


def _record(value) -> tuple[int | None, str | None, list | None]:
    """The fields of one record; ValueError for anything that is not one."""
    if not isinstance(value, dict):
        raise ValueError("not an object")
    sample_id, image, turns = (value.get(k) for k in ("sample_id", "image", "conversations"))
    if sample_id is not None and type(sample_id) is not int or abs(sample_id or 0) >= 2**63:
        raise ValueError("sample_id is not an integer")
    if turns is not None:
        if not isinstance(turns, list) or not all(isinstance(t, dict) for t in turns):
            raise ValueError("conversations are not turns")
        turns = [{"from": _text(t.get("from")), "value": _text(t.get("value"))} for t in turns]
    return sample_id, _text(image), turns


def parse(text: str | bytes) -> list[tuple] | None:
    """The records of a document; None if it is anything else, or has more than a document."""
    try:
        value = json.loads(text if isinstance(text, str) else text.decode())
        return [_record(v) for v in (value if isinstance(value, list) else [value])]
    except (ValueError, RecursionError):
        return None


def _parsed(lines: DataFrame, keep_corrupt: bool = True) -> DataFrame:
    """Records of the texts of (value, file, block, at).

    A null ``at`` numbers the records within each split; a text that has one is a single record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows = []
            for text, file, block, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not text.strip():
                    continue
                found = parse(text)
                if found is None:
                    if keep_corrupt:
                        rows.append((file, block, at, None, None, None, text.decode(errors="backslashreplace")))
                    continue
                for record in found:
                    place = at
                    if place is None:
                        place = counts[file, block] = counts.get((file, block), -1) + 1
                    rows.append((file, block, place, *record, None))
                if len(rows) >= ROWS_AT_ONCE:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    value = F.col("value").cast("binary").alias("value")
    return lines.select(value, "file", "block", "at").mapInArrow(run, _PARSED_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _PARSED)], schema=_PARSED
    )


def literal_path(name: str) -> str:
    """A file name with the characters that paths take as patterns escaped."""
    return re.sub(r"([\\\[\]{}*?^])", r"\\\1", name)


def _named(files: DataFrame) -> list[str]:
    """Paths that read exactly the files in ``file``, which Spark gives as URLs."""
    return [literal_path(urllib.parse.unquote(r["file"])) for r in files.select("file").toLocalIterator()]


def _lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return spark.read.text(path, **options).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.lit(None).cast("long").alias("at"))


def read_parsed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, record fields, _corrupt_record) of all files below ``path``.

    ``block`` is the start of the split that holds the text and ``at`` counts the
    records of a split. A file whose first character is a bracket is read as an
    array, in as many tasks as it has splits; a record of it that cannot be read
    is held alone. Other files, and those that turn out to be no array, are read
    by lines; of these, a file with an unreadable line is tried as one document.
    Names of files pass through the driver, which has listed all of them anyway.
    """
    kinds = json_array.begins_with_array(spark, path)
    arrays = _named(kinds.where("is_array"))
    frames, by_line = [], path
    if arrays:
        texts, refused = json_array.cut_records(spark, arrays)
        frames.append(_parsed(texts.withColumnRenamed("text", "value")))
        by_line = _named(kinds.where("NOT is_array")) + _named(refused)
    if by_line:
        lines = stored(_parsed(_lines(spark, by_line)), "lines")
        names = _named(lines.filter(f"{schemas.CORRUPT} is not null").select("file").distinct())
        if names:
            whole = _parsed(_lines(spark, names, wholetext=True), keep_corrupt=False)
            lines = lines.join(whole.select("file").distinct(), "file", "left_anti").select(
                *lines.columns).unionByName(whole)
        frames.append(lines)
    return functools.reduce(DataFrame.unionByName, frames)


def read_with_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable text); no line is on both sides or on none."""
    parsed = read_parsed(spark, path)
    records = parsed.filter(F.col(schemas.CORRUPT).isNull()).select(schemas.RECORD.names)
    return records, parsed.filter(F.col(schemas.CORRUPT).isNotNull()).select(schemas.CORRUPT)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with an explicit schema; fails if any text is unreadable."""
    records, held = read_with_quarantine(spark, path)
    first = held.first()
    if first is not None:
        raise ValueError(f"unreadable text in {path}: {first[0][:80]!r}")
    return records


def positioned(parsed: DataFrame) -> DataFrame:
    """Readable records with ``position``: 0, 1, ... by file name and place in the file.

    Only the counts of the splits are dealt by ranges and summed, first within a
    range and then over ranges, so that a position does not depend on how the
    files were split and no task sees all splits.
    """
    records = parsed.filter(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT)
    counts = records.groupBy("file", "block").agg(F.count("*").alias("_n"))
    ranged = stored(
        counts.repartitionByRange("file", "block").withColumn("_range", F.spark_partition_id()), "counts")
    running = lambda window: F.coalesce(
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_range").agg(F.sum("_n").alias("_n")).select(
        "_range", running(Window.orderBy("_range")).alias("_above"))
    offsets = ranged.withColumn("_inside", running(Window.partitionBy("_range").orderBy("file", "block"))).join(
        F.broadcast(ranges), "_range").select("file", "block", (F.col("_above") + F.col("_inside")).alias("_before"))
    return records.join(offsets, ["file", "block"]).withColumn(
        "position", F.col("_before") + F.col("at")
    ).drop("_before")


def identified(parsed: DataFrame) -> DataFrame:
    """Records whose ``sample_id`` is their position, for files whose records have no id."""
    return positioned(parsed).select(
        F.col("position").alias("sample_id"), "image", "conversations"
    )


def read_sources(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All sources that can be read, and (path, problem) for the others.

    A source is read once before it counts, so that one that fails while being
    read, or holds unreadable text, is reported here and not by a later job.
    """
    frames, problems = [], []
    for path in paths:
        try:
            frame = read_records(spark, path)
            frame.count()
            frames.append(frame)
        except Exception as error:  # a failing source is reported, the job goes on
            problems.append((path, str(error)))
    if not frames:
        raise ValueError(f"no source could be read: {problems}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out, problems


def write_records(records: DataFrame, path: str) -> None:
    records.write.json(path)


def write_samples(samples: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    samples.write.partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A table whose later joins on ``keys`` need no exchange."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
