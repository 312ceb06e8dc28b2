"""Micro-batches, optimizer steps and collation.

A batch holds ``size`` samples, so groups here are small by construction and
batch ids spread evenly over partitions.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import arrays as ar


def _div(col: str, by: int):
    return F.expr(f"`{col}` div {int(by)}")


def micro_batches(indexed: DataFrame, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Adds ``batch_id``; the last batch may be short."""
    return indexed.withColumn("batch_id", _div("idx", size))


def accumulation_steps(batches: DataFrame, accumulation: int = fixed.ACCUMULATION) -> DataFrame:
    """(step, n_batches, n_samples) from rows that carry ``batch_id``."""
    per_batch = batches.groupBy("batch_id").agg(F.count("*").alias("n"))
    return (
        per_batch.groupBy(_div("batch_id", accumulation).alias("step"))
        .agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_samples"))
    )


def batch_width(column: str, multiple_of: int | None = None):
    widest = F.max(F.size(column)).over(Window.partitionBy("batch_id"))
    return ar.round_up(widest, multiple_of)


def pad_in_batch(
    batched: DataFrame, fills: dict[str, int], multiple_of: int | None = None
) -> DataFrame:
    """Pads each named array column to its longest in the batch.

    All columns share one shuffle by ``batch_id``.
    """
    for name in fills:
        batched = batched.withColumn(f"_{name}_width", batch_width(name, multiple_of))
    for name, fill in fills.items():
        batched = batched.withColumn(
            name, ar.pad_right(F.col(name), F.col(f"_{name}_width"), fill)
        ).drop(f"_{name}_width")
    return batched


def collation_fills(pad_id: int = fixed.PAD_ID) -> dict[str, int]:
    return {"input_ids": pad_id, "attention_mask": 0, "labels": fixed.IGNORE_INDEX}


def stack(batched: DataFrame, columns: list[str], same_size: list[str]) -> DataFrame:
    """One row per batch with the columns stacked in sample order.

    Arrays named in ``same_size`` must have equal lengths within the batch.
    """
    entry = F.struct("idx", *columns)
    sizes = []
    for name in same_size:
        sizes += [F.min(F.size(name)).alias(f"_{name}_min"), F.max(F.size(name)).alias(f"_{name}_max")]
    grouped = batched.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_rows"), F.count("*").alias("n"), *sizes
    )
    out = []
    for name in columns:
        stacked = F.col("_rows")[name]
        if name in same_size:
            failure = F.raise_error(F.lit(f"cannot stack {name}: sizes differ in a batch"))
            stacked = F.when(
                F.col(f"_{name}_min") == F.col(f"_{name}_max"), stacked
            ).otherwise(failure)
        out.append(stacked.alias(name))
    return grouped.select("batch_id", "n", *out)


def collate(
    batched: DataFrame, pad_id: int = fixed.PAD_ID, multiple_of: int | None = None,
    images: str | None = None,
) -> DataFrame:
    """Batch records: padded ids, mask and labels, and stacked images if named."""
    fills = collation_fills(pad_id)
    padded = pad_in_batch(batched, fills, multiple_of)
    columns = list(fills) + ([images] if images else [])
    return stack(padded, columns, [images] if images else [])
