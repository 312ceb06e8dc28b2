"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

TURN = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("value", T.StringType()),
])

CORRUPT = "_corrupt_record"

RECORD = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("image", T.StringType()),
    T.StructField("conversations", T.ArrayType(TURN)),
])
