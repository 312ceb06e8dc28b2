"""Features computed once per picture.

A table below ``path`` holds features by digest of the picture and version of
the encoder. Pictures that it lacks are encoded once each, however often and
under however many names they occur, and added; all others are looked up.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.operators.skew import salted_join
from dialogprep.sources.scratch import stored


def digest(images: DataFrame) -> Column:
    """Digest of a decoded picture: its shape and bytes; null if it is unreadable."""
    head = F.concat_ws("x", *(F.col(c).cast("string") for c in ("height", "width", "channels")))
    return F.when(F.col("readable"), F.sha2(F.concat(F.encode(head, "UTF-8"), F.col("data")), 256))


class FeatureStore:
    """Features by (digest, encoder version). ``kind`` is the type of ``features``.

    A run writes the pictures it encodes to a folder named by itself; the same
    picture added by two runs at once is read once.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, kind: str = "array<double>"):
        self.spark, self.path, self.kind = spark, f"{path}/version={version}", kind

    def read(self) -> DataFrame:
        """(digest, features), each digest once."""
        schema = f"digest string, features {self.kind}"
        try:
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        return rows.groupBy("digest").agg(F.any_value("features").alias("features"))

    def attach(self, pictures: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
        """``pictures`` (key, digest, ...) with ``features``, null where the digest is.

        ``encode`` gets one row of each picture that is not known yet and adds
        ``features``. ``key`` tells the pictures apart. Pictures are made once, and written
        until the end, because reading and decoding them takes longest.
        """
        pictures = stored(pictures, "pictures")
        narrow = pictures.select(key, "digest")
        unknown = narrow.where(F.col("digest").isNotNull()).join(self.read().select("digest"), "digest", "left_anti")
        # One name for each digest; which of equal pictures it is makes no difference.
        first = stored(unknown.groupBy("digest").agg(F.min(key).alias(key)), "new")
        if not first.isEmpty():
            new = stored(pictures.join(first.select(key), key, "left_semi"), "new")
            encode(new.dropDuplicates(["digest"])).select("digest", "features").write.mode("append").parquet(self.path)
        return salted_join(narrow, self.read(), ["digest"], [key])
