"""Samples stored by position, to be fetched by position.

A position lies in the shard ``position div rows``, a folder of its own, in which
rows stand in order and in small row groups; so the folder comes from arithmetic
and the row group from the statistics in the file. Neither other folders are
listed nor other row groups read. A store has numbered versions, of which the
last finished one counts.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_SHARD = 100_000
ROW_GROUP_BYTES = 8 << 20
# Positions given as a list; more come as a table.
MAX_LISTED = 10_000

_MARK = "version long, n long, rows_per_shard long, schema string"


class SampleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _mark(self):
        try:
            marks = self.spark.read.schema(_MARK).option("recursiveFileLookup", True).parquet(f"{self.path}/marks")
            return marks.orderBy(F.desc("version")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def write(
        self, samples: DataFrame, positions: DataFrame, key: str, rows_per_shard: int = ROWS_PER_SHARD,
        row_group_bytes: int = ROW_GROUP_BYTES,
    ) -> int:
        """Writes ``samples`` by the ``idx`` that ``positions`` (key, idx) gives them.

        One shuffle of the samples, by shard. Returns the version.
        """
        mark = self._mark()
        version = (mark["version"] if mark else 0) + 1
        placed = samples.join(positions.select(key, "idx"), key).withColumn(
            "shard", F.expr(f"idx div {int(rows_per_shard)}"))
        ordered = placed.repartition("shard").sortWithinPartitions("shard", "idx")
        ordered.write.mode("overwrite").partitionBy("shard").option(
            "parquet.block.size", row_group_bytes).parquet(f"{self.path}/data/{version}")
        kept = placed.drop("shard").schema
        n = positions.count()
        self.spark.createDataFrame([(version, n, rows_per_shard, kept.json())], _MARK).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/marks/{version}")
        return version

    def _finished(self):
        mark = self._mark()
        if mark is None:
            raise ValueError(f"{self.path} holds no finished version")
        return mark

    def _reader(self, mark):
        schema = StructType.fromJson(json.loads(mark["schema"])).add("shard", "long")
        base = f"{self.path}/data/{mark['version']}"
        return self.spark.read.schema(schema).option("basePath", base), base

    def read(self) -> DataFrame:
        """All samples with ``idx``."""
        reader, base = self._reader(self._finished())
        return reader.parquet(base).drop("shard")

    def fetch(self, positions: list[int]) -> DataFrame:
        """The samples at some positions, each once; IndexError for one that does not exist."""
        if len(positions) > MAX_LISTED:
            raise ValueError("give so many positions as a table to fetch_all")
        mark = self._finished()
        wrong = [p for p in positions if not 0 <= p < mark["n"]]
        if wrong:
            raise IndexError(f"no sample at {wrong[:5]}; there are {mark['n']}")
        reader, base = self._reader(mark)
        shards = sorted({p // mark["rows_per_shard"] for p in positions})
        if not shards:
            return self.read().limit(0)
        wanted = F.lit(False)
        for shard in shards:
            # A range for each shard prunes row groups even where the list is long.
            own = [p for p in positions if p // mark["rows_per_shard"] == shard]
            wanted = wanted | ((F.col("shard") == shard) & F.col("idx").between(min(own), max(own)) & F.col("idx").isin(own))
        return reader.parquet(*(f"{base}/shard={s}" for s in shards)).where(wanted).drop("shard")

    def fetch_all(self, positions: DataFrame) -> DataFrame:
        """The samples at the positions ``idx`` of a table, joined within their shards."""
        mark = self._finished()
        reader, base = self._reader(mark)
        wanted = positions.select("idx").distinct().withColumn("shard", F.expr(f"idx div {mark['rows_per_shard']}"))
        return reader.parquet(base).join(wanted, ["shard", "idx"], "left_semi").drop("shard")
