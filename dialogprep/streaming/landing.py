"""Record files landed as a stream, with quarantine.

The stream carries the names of new files; each batch reads its files as the
batch reader does, so arrays, lines and unreadable text come out alike. A batch
is written by one job into a folder of its own number that a repeated batch
replaces, and counts only once its mark is there, so that a restart in the
middle of a batch neither loses nor repeats a record.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import schemas
from dialogprep.sources import records

GOOD, HELD = "good", "quarantined"
# Files of a batch: their names pass through the driver.
FILES_AT_ONCE = 10_000

_MARK = T.StructType([T.StructField("batch", T.LongType())])
_FILE = "path string, modificationTime timestamp, length long, content binary"
_FIELDS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.RECORD)
_LANDED = f"batch long, status string, file string, block long, at long, {_FIELDS}, {schemas.CORRUPT} string"


def _write_batch(names: DataFrame, batch: int, out: str) -> None:
    spark = names.sparkSession
    paths = [records.literal_path(r["path"]) for r in names.toLocalIterator()]
    if not paths:
        return
    parsed = records.read_parsed(spark, paths)
    status = F.when(F.col(schemas.CORRUPT).isNull(), F.lit(GOOD)).otherwise(F.lit(HELD))
    parsed.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(
        f"{out}/data/batch={batch}")
    spark.createDataFrame([(batch,)], _MARK).coalesce(1).write.mode("overwrite").parquet(
        f"{out}/marks/{batch}")


def land(
    spark: SparkSession, folder: str, out: str, progress: str, files_at_once: int = FILES_AT_ONCE
):
    """Starts a query that lands all files present in ``folder`` below ``out``, then stops."""
    names = (
        spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_at_once).load(folder).select("path")
    )
    return (
        names.writeStream.foreachBatch(lambda batch, number: _write_batch(batch, number, out))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def landed(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable text with its file) of all finished batches below ``out``."""
    marks = spark.read.schema(_MARK).option("recursiveFileLookup", True).parquet(f"{out}/marks")
    rows = spark.read.schema(_LANDED).option("basePath", f"{out}/data").parquet(f"{out}/data")
    done = rows.join(F.broadcast(marks), "batch", "left_semi")
    good = done.where(F.col("status") == GOOD).select("batch", "file", "block", "at", *schemas.RECORD.names)
    return good, done.where(F.col("status") == HELD).select("batch", "file", schemas.CORRUPT)
