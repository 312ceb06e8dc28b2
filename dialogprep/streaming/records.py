"""The row-local operators over arriving record files; stateless."""

from pyspark.sql import DataFrame, SparkSession

from dialogprep import fixed, schemas
from dialogprep.functions import text as tx
from dialogprep.operators.tokens import Codebook
from dialogprep.plans import jobs


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON-lines files as they appear in ``folder``."""
    return spark.readStream.schema(schemas.RECORD).json(folder)


def stream_samples(
    spark: SparkSession, folder: str, codebook: Codebook, length: int = fixed.MAX_LENGTH
) -> DataFrame:
    """Padded ids, masks and labels of arriving records, with a shared vocabulary.

    A larger vocabulary is joined once the records have landed (``jobs.prepare_records``).
    """
    return jobs.prepare_records(read_stream(spark, folder), codebook, length)


def stream_dialogues(spark: SparkSession, folder: str, order: str = "grouped") -> DataFrame:
    """Rendered dialogues of arriving records."""
    records = read_stream(spark, folder)
    return records.select(
        "sample_id", "image",
        tx.dialogue("conversations", order).alias("text"),
    )


def drain(stream: DataFrame, out: str, progress: str) -> None:
    """Processes all files present, then stops; ``progress`` makes it exactly-once."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
