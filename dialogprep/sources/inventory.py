"""An inventory of files that is listed by tasks and kept between runs.

Folders are listed where Spark's tasks run: each takes some folders, lists what
is below them up to a number of entries and hands the folders it has not reached
to the next round, so that a deep or uneven tree is shared out. A manifest keeps
what is known of each file; a refresh compares path, size and time and works on
files that are new or changed alone.

Listing needs a file system that pyarrow knows (local, HDFS, S3, GCS); elsewhere
use ``images.list_images``, for which Spark lists.
"""

import datetime
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.sources.scratch import stored

# Entries that a task lists before it hands folders on, and tasks of a round.
ENTRIES_AT_ONCE, TASKS = 10_000, 64
# Names that pass through the driver at once to be read.
NAMES_AT_ONCE = 10_000

ADDED, CHANGED, REMOVED, SAME = "added", "changed", "removed", "same"

_LISTED = pa.schema([
    ("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()),
    ("modified", pa.timestamp("us", "UTC")),
])
_DDL = "path string, folder boolean, length long, modified timestamp"


def local_path(path: str) -> str:
    """Local paths without scheme, as pyarrow opens them whatever characters they hold."""
    return re.sub("^file:/+", "/", path)


def _opened(path: str):
    """(file system, base, prefix of what it lists) of a path."""
    from pyarrow import fs

    if re.match("[a-z0-9]+://", path):
        files, base = fs.FileSystem.from_uri(path)
        return files, base, path[:path.index(base)] if base in path else ""
    return fs.LocalFileSystem(), path, "file:"


def _below(path: str, entries: int) -> Iterator[tuple]:
    """Rows of the files below a folder, and of the folders left for later."""
    from pyarrow import fs

    files, base, prefix = _opened(local_path(path))
    waiting, seen = [base], 0
    while waiting:
        if seen >= entries:
            for folder in waiting:
                yield prefix + folder, True, None, None
            return
        for info in files.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
            seen += 1
            if info.type == fs.FileType.Directory:
                waiting.append(info.path)
            else:
                yield prefix + info.path, False, info.size, info.mtime


def _list(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _below(path, entries)
                while some := list(islice(rows, ENTRIES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*some), _LISTED)], schema=_LISTED)

    return run


def list_files(spark: SparkSession, folder: str, entries: int = ENTRIES_AT_ONCE) -> DataFrame:
    """(path, length, modified) of all files below ``folder``; a missing one has none.

    Rounds are written and read back; the folders to list stay in tables.
    """
    frontier = spark.createDataFrame([(folder.rstrip("/"),)], "path string")
    found = None
    while True:
        spread = frontier.coalesce(1) if found is None else frontier.repartition(TASKS, "path")
        listed = stored(spread.mapInArrow(_list(entries), _DDL), "listing")
        files = listed.where("NOT folder").select("path", "length", "modified")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("folder").select("path")
        if frontier.isEmpty():
            return found


def compared(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, length, modified, change): what has become of each file."""
    old = before.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified"))
    change = (
        F.when(F.col("modified").isNull(), REMOVED).when(F.col("_modified").isNull(), ADDED)
        .when(same, SAME).otherwise(CHANGED))
    return now.join(old, "path", "full").select("path", "length", "modified", change.alias("change"))


class Manifest:
    """What is known of the files of a folder, in numbered versions below ``path``.

    ``facts`` is the schema of what ``work`` finds out about a file, besides its
    path. A version counts once its mark is written, so a run that breaks off
    leaves the one before.
    """

    def __init__(self, spark: SparkSession, path: str, facts: str):
        self.spark, self.path = spark, path
        self.schema = f"path string, length long, modified timestamp, version long, {facts}"
        self.facts = [f.name for f in spark.createDataFrame([], facts).schema]

    def version(self) -> int:
        """Number of the last finished version; 0 if there is none."""
        try:
            marks = self.spark.read.schema("version long").option("recursiveFileLookup", True).parquet(f"{self.path}/marks")
            return marks.agg(F.max("version")).first()[0] or 0
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return 0

    def read(self) -> DataFrame:
        """(path, length, modified, version, facts): ``version`` is when a file was worked on."""
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/versions/{number}")

    def refresh(
        self, now: DataFrame, work: Callable[[list[str]], DataFrame], names_at_once: int = NAMES_AT_ONCE
    ) -> DataFrame:
        """(path, length, modified, change) against a listing; the manifest then tells ``now``.

        ``work`` gets names of files that are new or changed, some at a time, and
        returns (path, facts) of each.
        """
        before, number = self.read(), self.version() + 1
        changes = stored(compared(before, now), "changes")
        out = f"{self.path}/versions/{number}"
        columns = ["path", "length", "modified", "version", *self.facts]
        kept = before.join(changes.where(F.col("change") == SAME).select("path"), "path", "left_semi")
        kept.select(columns).write.mode("overwrite").parquet(out)
        names = iter(changes.where(F.col("change").isin(ADDED, CHANGED)).select("path").toLocalIterator())
        while some := [row["path"] for row in islice(names, names_at_once)]:
            asked = changes.join(self.spark.createDataFrame([(n,) for n in some], "path string"), "path", "left_semi")
            asked.drop("change").join(work(some), "path", "left").withColumn(
                "version", F.lit(number).cast("long")).select(columns).write.mode("append").parquet(out)
        self.spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/marks/{number}")
        return changes
