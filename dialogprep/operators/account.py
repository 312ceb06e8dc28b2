"""How much of a total is flagged."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep import fixed


def flagged_share(df: DataFrame, amount, flag, by: list[str] = ()) -> DataFrame:
    """(flagged, total, percent to 2 places), e.g. trainable of all parameters."""
    return (
        df.groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.when(flag, amount)), F.lit(0)).cast("long").alias("flagged"),
            F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("total"),
        )
        .withColumn("percent", F.round(
            F.lit(100.0) * F.col("flagged") / F.nullif(F.col("total"), F.lit(0)), 2))
    )


def supervised_token_share(samples: DataFrame, labels: str, by: list[str] = ()) -> DataFrame:
    """Share of label positions that carry loss; shows what truncation costs."""
    counted = F.size(F.filter(labels, lambda v: v != fixed.IGNORE_INDEX)).cast("long")
    return (
        samples.groupBy(*by)
        .agg(F.sum(counted).alias("flagged"), F.sum(F.size(labels).cast("long")).alias("total"))
        .withColumn("percent", F.round(
            F.lit(100.0) * F.col("flagged") / F.nullif(F.col("total"), F.lit(0)), 2))
    )
