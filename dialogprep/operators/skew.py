"""Keys that hold a large share of the rows, and operators that survive them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], floor: int, share: float) -> DataFrame:
    """Keys with more than ``max(floor, share * rows)`` rows; null is no key.

    There are at most ``1 / share`` of them whatever the size of ``df``, which
    is what makes the result fit for a broadcast. Counting combines map-side, so
    a hot key costs one partial row per task; the total comes from the counts.
    """
    if not share > 0:
        raise ValueError("share must be above 0: it bounds the number of heavy keys")
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    counts = present.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = counts.agg(F.sum("_n").alias("_rows")).scalar()
    limit = F.greatest(F.lit(float(floor)), rows * F.lit(share))
    return counts.filter(F.col("_n") > limit).select(*keys)


def flag_heavy(
    df: DataFrame, keys: list[str], flag: str, floor: int, share: float
) -> DataFrame:
    """Adds a boolean column telling whether the row's key is heavy."""
    heavy = heavy_keys(df, keys, floor, share).withColumn(flag, F.lit(True))
    return df.join(F.broadcast(heavy), keys, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    salt_by: list[str],
    how: str = "left",
    salts: int = 64,
    floor: int = 100_000,
    share: float = 1e-4,
) -> DataFrame:
    """Equi-join whose heavy left keys are spread over ``salts`` partitions.

    Only right rows of heavy keys are repeated, at most ``salts / share`` of
    them when the right side is unique on ``keys``. Null keys match nothing and
    are spread as well. The salt is a hash of row values, so a retried task
    sends each row to the same place.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_join supports left and inner joins")
    heavy = heavy_keys(left, keys, floor, share).withColumn("_heavy", F.lit(True))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    spread = F.col("_heavy").isNotNull() | no_key
    salted_left = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt",
        F.when(spread, F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"),
    ).drop("_heavy")
    salted_right = right.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1)))
                  .otherwise(F.array(F.lit(0)))),
    ).drop("_heavy")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    The optimizer cuts each task's rows to ``n`` per key before the shuffle, up
    to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def cut_heavy(
    df: DataFrame, key: str, order: list[str], n: int, floor: int, share: float, salts: int = 64
) -> DataFrame:
    """Drops, where they are read, rows of heavy keys behind their first ``n``.

    The ``n``-th place of each heavy key is found from the narrow columns alone,
    in two steps so that no task sees a whole key, and broadcast: at most
    ``1 / share`` rows. Other keys pass unchanged. ``order`` must be unique
    within a key.
    """
    heavy = heavy_keys(df, [key], floor, share)
    narrow = df.join(F.broadcast(heavy), key, "left_semi").select(
        key, *order, F.pmod(F.xxhash64(*order), F.lit(salts)).alias("_salt")
    )
    some = keep_first(narrow, [key, "_salt"], order, n)
    last = keep_first(some, [key], order, n).groupBy(key).agg(
        F.max(F.struct(*order)).alias("_last")
    )
    return (
        df.join(F.broadcast(last), key, "left")
        .filter(F.col("_last").isNull() | (F.struct(*order) <= F.col("_last")))
        .drop("_last")
    )
