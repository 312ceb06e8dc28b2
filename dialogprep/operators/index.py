"""Dense positions 0..n-1 without a window over all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits dropped at each level. A bucket holds at most 2^18 unique keys and a
# parent at most 2^22 buckets; 2^24 parents remain for any 64-bit key.
KEY_SHIFTS = (18, 22)
# Hashed keys of 60 bits are uniform: 2^16 even buckets at once.
HASH_SHIFTS = (44,)


def _bucket_offsets(counts: DataFrame, shifts) -> DataFrame:
    """(bucket, offset) from (bucket, n): rows in all smaller buckets.

    Sums run inside a parent bucket and add the parent's own offset, so every
    window but the last is partitioned, and the last one sees a fixed maximum
    of rows set by the shifts, not by the data.
    """
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n").over(before), F.lit(0))
    if not shifts:
        return counts.select("bucket", running.alias("offset"))
    nested = counts.withColumn("parent", F.shiftright("bucket", shifts[0]))
    parents = nested.groupBy(F.col("parent").alias("bucket")).agg(F.sum("n").alias("n"))
    base = _bucket_offsets(parents, shifts[1:]).select(
        F.col("bucket").alias("parent"), F.col("offset").alias("base")
    )
    inside = F.sum("n").over(before.partitionBy("parent"))
    return nested.withColumn("inside", F.coalesce(inside, F.lit(0))).join(base, "parent").select(
        "bucket", (F.col("base") + F.col("inside")).alias("offset")
    )


def _positions(keys: DataFrame, order: list[str], shifts) -> DataFrame:
    bucketed = keys.withColumn("bucket", F.shiftright(order[0], shifts[0]))
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = _bucket_offsets(counts, shifts[1:])
    window = Window.partitionBy("bucket").orderBy(*order)
    # Equal keys are neighbours; counting them would leave the positions to chance.
    repeated = F.lag(order[-1]).over(window) == F.col(order[-1])
    failure = F.raise_error(F.lit("a repeated key cannot be positioned")).cast("long")
    return (
        bucketed.withColumn("_rank", F.row_number().over(window) + F.when(repeated, failure).otherwise(0))
        .join(offsets, "bucket")
        .withColumn("idx", (F.col("offset") + F.col("_rank") - 1).cast("long"))
    )


def _required(key: str):
    """The key as a non-null bigint; a null key fails the job.

    Being non-null, it draws no inferred filters, so the counting and the
    ranking branch read the same input and can share its exchanges.
    """
    failure = F.raise_error(F.lit(f"null {key} cannot be positioned")).cast("long")
    return F.coalesce(F.col(key).cast("long"), failure, F.lit(0))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """(key, idx): position of each row in ascending order of a unique integer key.

    Buckets are functions of the key's value, so a recomputed task or a
    different partitioning gives the same positions. Only the key is shuffled;
    join the result back for a payload.
    """
    keys = df.select(_required(key).alias(key))
    return _positions(keys, [key], KEY_SHIFTS).select(key, "idx")


def shuffled_index(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, idx) in a pseudo-random order that depends on key and seed only."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    draw = F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(0))
    keys = df.select(_required(key).alias(key)).withColumn("_draw", draw)
    return _positions(keys, ["_draw", key], HASH_SHIFTS).select(key, "idx")


def fetch(df: DataFrame, index: DataFrame, key: str, positions: list[int]) -> DataFrame:
    """Rows at the given positions."""
    wanted = index.filter(F.col("idx").isin(*positions))
    return df.join(F.broadcast(wanted), key)
