"""Image requirement of a record: split instead of failing, or fail on demand."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.operators.skew import salted_join

NO_IMAGE, NOT_FOUND, UNREADABLE = "no_image", "not_found", "unreadable"


def attach_images(
    records: DataFrame, images: DataFrame, key: str, salt_by: str | list[str], **skew
) -> DataFrame:
    """Left join to an image table that is unique on ``key``; adds ``found``.

    Many records may share one image, so heavy image keys are salted by columns
    that differ among their records. A missing or empty key is treated as null,
    which is spread the same way.
    """
    salt_by = [salt_by] if isinstance(salt_by, str) else list(salt_by)
    if key in salt_by or not salt_by:
        raise ValueError("the salt needs columns other than the key, or a hot key stays together")
    named = records.withColumn(
        key, F.when(F.col(key).cast("string") != "", F.col(key))
    )
    return salted_join(
        named, images.withColumn("found", F.lit(True)), [key], salt_by, "left", **skew
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def rejection_reason(key: str, readable=None):
    """Null for an accepted record."""
    reason = F.when(F.col(key).isNull(), NO_IMAGE).when(~F.col("found"), NOT_FOUND)
    return reason if readable is None else reason.when(~readable, UNREADABLE)


def require_image(
    records: DataFrame, images: DataFrame, key: str, salt_by: str | list[str],
    readable: str | None = None, **skew,
) -> DataFrame:
    """Records with a ``reason`` column: null when accepted."""
    attached = attach_images(records, images, key, salt_by, **skew)
    flag = None if readable is None else F.col(readable)
    return attached.withColumn("reason", rejection_reason(key, flag))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason", "found")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def strict(checked: DataFrame) -> DataFrame:
    """Fails the job at the first rejected record."""
    failure = F.raise_error(F.concat(F.lit("record rejected: "), F.col("reason")))
    return checked.filter(
        F.when(F.col("reason").isNull(), F.lit(True)).otherwise(failure.cast("boolean"))
    )
